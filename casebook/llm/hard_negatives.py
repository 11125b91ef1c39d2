"""Hard negatives by inner product, with length buckets and pruning by coordinates (LEMP, Teflioudi et al. 2015)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.store import forget, written
from casebook.llm.vectors import finite, matrix

PIECE = 8192  # rows that one index holds
LENGTHS = 0.9  # the shortest vector of a bucket has at least this part of the longest's length
SMALLEST = 64  # a bucket has at least so many rows, whatever their lengths
FOCUS = 5  # coordinates of an anchor that are looked up
BLOCK_BYTES = 16 << 20  # anchors that travel to all tasks at once
EXACT = 2.0 ** 53  # below this bound sums of whole numbers are exact in doubles
LONG = 2 ** 63


@dataclass
class _Bucket:
    """Rows of about one length, and for every coordinate their order by its value in the unit vectors."""

    rows: np.ndarray
    longest: float
    order: np.ndarray
    values: np.ndarray


class Index:
    """Some rows in buckets of falling length."""

    def __init__(self, x: np.ndarray):
        self.x = x
        length = np.sqrt((x * x).sum(1))
        by_length, self.buckets = np.argsort(-length, kind="stable"), []
        start = 0
        while start < len(x):
            longest = length[by_length[start]]
            stop = start + max(SMALLEST, int((length[by_length[start:]] >= LENGTHS * longest).sum()))
            rows = by_length[start:stop]
            unit = x[rows] / np.where(length[rows] > 0, length[rows], 1)[:, None]
            order = np.argsort(unit, axis=0)
            self.buckets.append(_Bucket(rows, longest, order.T.copy(), np.take_along_axis(unit, order, 0).T.copy()))
            start = stop

    def above(self, q: np.ndarray, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, inner products) of every bucket that may hold rows with a product of ``least()`` or more.

        With unit vectors q, p and their product at least t, the coordinate p_f lies within
        q_f t +- sqrt((1 - q_f^2) (1 - t^2)). The rows inside that range for all focus coordinates are verified.
        """
        length = np.sqrt((q * q).sum())
        unit = q / length if length > 0 else q
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for b in self.buckets:
            bound, reach = least(), length * b.longest
            if reach < bound * (1 - 1e-9) - 1e-9:
                return  # all that follow are shorter
            rows = b.rows
            t = min(1.0, bound / reach) - 1e-9 if reach > 0 else 0.0
            if t > 0:
                wide = np.sqrt(np.maximum((1 - unit[focus] ** 2) * (1 - t * t), 0)) + 1e-9
                seen, asked = None, 0
                for f, middle, w in zip(focus, unit[focus] * t, wide, strict=True):
                    # the cap of such vectors around q may hold the axis itself
                    low = -1.0 if -unit[f] >= t else middle - w
                    high = 1.0 if unit[f] >= t else middle + w
                    first = np.searchsorted(b.values[f], low, "left")
                    last = np.searchsorted(b.values[f], high, "right")
                    if last - first < len(rows):
                        seen = np.zeros(len(rows), np.int8) if seen is None else seen
                        seen[b.order[f, first:last]] += 1
                        asked += 1
                if asked:
                    rows = rows[seen == asked]
            if len(rows):
                yield rows, products(self.x[rows], q)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, cut to the range of a long."""
    size = np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1).max())
    if size < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), -LONG), LONG - 1) for row in x],
                    dtype=np.int64)


class _Best:
    """The k best (score, id) found among scores of 0 or more, ties to smaller ids."""

    def __init__(self, k: int, least: int = 0):
        self.k, self.least, self.scores, self.ids = k, least, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.least = int(self.scores[-1])  # what a further row must reach to matter


def _pieces(batches: Iterator[pa.RecordBatch], dims: int):
    """(ids, labels, vectors) of about ``PIECE`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PIECE:
            yield _rows(pa.Table.from_batches(held), dims)
            held, n = [], 0
    if n:
        yield _rows(pa.Table.from_batches(held), dims)


def _rows(t: pa.Table, dims: int) -> tuple[np.ndarray, list, np.ndarray]:
    x = t.column("x").combine_chunks()
    x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
    return t.column("id").to_numpy(), t.column("label").to_pylist(), matrix(x, dims, np.float64)


def _first(found: DataFrame, k: int, *each: str) -> DataFrame:
    """The k best rows of each group, numbered; tasks keep k of a group before the shuffle."""
    order = Window.partitionBy(*each).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, anchors, dims: int, k: int) -> DataFrame:
    """(anchor, rank, id, score): the k best rows with an anchor's label, if their score is 0 or more."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = anchors.value
        asking: dict = {}
        for i, label in enumerate(labels):
            asking.setdefault(label, []).append(i)
        best = [_Best(k) for _ in ids]
        for their_ids, their_labels, their_x in _pieces(batches, dims):
            of: dict = {}
            for j, label in enumerate(their_labels):
                if label in asking:
                    of.setdefault(label, []).append(j)
            for label, members in of.items():
                mine, index = their_ids[members], Index(their_x[members])
                for i in asking[label]:
                    for at, scores in index.above(x[i], lambda b=best[i]: b.least):
                        other = mine[at] != ids[i]
                        best[i].add(scores[other], mine[at][other])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
            pa.array(np.concatenate([b.ids for b in best]), pa.int64()),
            pa.array(np.concatenate([b.scores for b in best]), pa.int64())], names=["anchor", "id", "score"])

    return _first(rows.mapInArrow(search, "anchor int, id long, score long"), k, "anchor")


def _negatives(rows: DataFrame, anchors, positives, dims: int, k: int, least: int) -> DataFrame:
    """(pair, rank, id, score): for every row of ``positives`` the k best rows of other labels in its range."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, x = anchors.value
        of, top = positives.value
        best = [_Best(k, -(-least * p // 100)) for p in top.tolist()]
        pairs: dict[int, list[int]] = {}
        for pair, i in enumerate(of.tolist()):
            pairs.setdefault(i, []).append(pair)
        code: dict = {}
        own = [code.setdefault(label, len(code)) for label in labels]
        for their_ids, their_labels, their_x in _pieces(batches, dims):
            theirs = np.array([code.get(label, -1) for label in their_labels])
            index = Index(their_x)
            for i, mine in pairs.items():
                for at, scores in index.above(x[i], lambda m=mine: min(best[p].least for p in m)):
                    other = theirs[at] != own[i]
                    scores, ids = scores[other], their_ids[at][other]
                    for p in mine:
                        below = scores <= top[p]
                        best[p].add(scores[below], ids[below])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
            pa.array(np.concatenate([b.ids for b in best]), pa.int64()),
            pa.array(np.concatenate([b.scores for b in best]), pa.int64())], names=["pair", "id", "score"])

    return _first(rows.mapInArrow(search, "pair int, id long, score long"), k, "pair")


def mine(df: DataFrame, anchors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
         positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of ``anchors``.

    Vectors hold whole numbers (any numeric type); a score is their inner product, exact up to the range of a long, to
    which greater ones are cut. An anchor's positives are its ``positives`` best other rows of the same label; for each
    the result has the ``negatives`` best rows of other labels whose score lies between ``least`` % of the positive's
    score and that score. Equal scores go by smaller key. There is none for a positive below 0.

    Anchors go out in blocks of at most ``BLOCK_BYTES``, and every task searches its own rows for a block: it keeps the
    best of each anchor and hands on no more than these. Rows are indexed ``PIECE`` at a time, in buckets of falling
    length with sorted coordinate lists; the score that an anchor still has to beat gives the range of its focus
    coordinates, and only rows inside all ranges are multiplied. No row is moved, so no label or vector can be hot.

    Rows with a null key, label or vector, or with a null or non-finite component take no part. A shorter vector counts
    as if zeros followed; zero vectors are rows like others. Repeated rows are candidates each, and repeated anchors
    are answered each; a row with the anchor's key is never its positive. Other columns are not read. Empty tables give
    no rows.
    """
    spark = df.sparkSession
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    def good(rows: DataFrame) -> DataFrame:
        return rows.where(finite(vector) & F.col(key).isNotNull() & F.col(label).isNotNull()).select(
            F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"))

    rows, asked = written(good(df), "candidates"), written(good(anchors), "anchors")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    dims = max(1, size["dims"] or 0, rows.agg(F.max(F.size("x"))).first()[0] or 0)
    blocks, results = -(-size["n"] * dims * 8 // BLOCK_BYTES), []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)) == block).toArrow()
        if part.num_rows:
            sent = spark.sparkContext.broadcast(_rows(part, dims))
            found = _positives(rows, sent, dims, positives).toArrow()
            of, ids, top = (found.column(c).to_numpy() for c in ("anchor", "id", "score"))
            above = spark.sparkContext.broadcast((of, top))
            # the block's pairs are as bounded as its anchors
            pairs = pa.table({"pair": pa.array(np.arange(len(of)), pa.int32()), "anchor_id": sent.value[0][of],
                              "positive_id": ids, "positive_score": top})
            best = _negatives(rows, sent, above, dims, negatives, least)
            results.append(written(best.join(F.broadcast(spark.createDataFrame(pairs)), "pair").select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")), "negatives"))
    forget(rows, asked)
    if not results:
        return spark.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, results)
