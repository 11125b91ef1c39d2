"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.pq_dedup import usable
from casebook.llm.store import written

CURVES = 16
DIMS, BITS = 6, 5
WINDOW = 0.045  # half a window's share of all rows; see ``neighbours``
LEAST_ROWS = 500  # rows on either side of a query that its window holds at least, as far as there are so many
SEGMENTS = 200  # cuts of a curve, fitted on a sample
SAMPLE = 20_000
PIECE = 4_000  # rows of a segment that one task compares with a block of queries
QUERIES = 2_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer cells (rows × dimensions) on the Hilbert curve (Skilling 2004: undo excess work, Gray code)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Per curve a projection and a shifted grid; cuts that split a sample's keys into equal segments."""

    mean: np.ndarray
    axes: np.ndarray  # (curve, dimension of the vector, projected dimension)
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray
    cuts: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, curves: int = CURVES) -> Curves:
        rng = np.random.default_rng(13)
        axes = rng.normal(size=(curves, x.shape[1], DIMS))
        flat = np.einsum("nd,cdp->cnp", x - x.mean(0), axes)
        low, high = flat.min(1), flat.max(1)
        made = cls(x.mean(0), axes, low, np.maximum(high - low, 1e-12), rng.uniform(size=(curves, DIMS)), [])
        for keys in made.keys(x):
            made.cuts.append(np.quantile(keys, np.arange(1, SEGMENTS) / SEGMENTS, method="lower"))
        return made

    def keys(self, x: np.ndarray) -> np.ndarray:
        flat = np.einsum("nd,cdp->cnp", x - self.mean, self.axes)
        at = ((flat - self.low[:, None]) / self.width[:, None] + self.shift[:, None]) / 2 * (1 << BITS)
        cells = np.clip(at, 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert_keys(c, BITS) for c in cells])

    def segments(self, x: np.ndarray) -> np.ndarray:
        """(curve, row) numbers of the segments that hold the rows."""
        return np.stack([np.searchsorted(c, k, "right") for c, k in zip(self.cuts, self.keys(x), strict=True)])


def _nearest(ids: np.ndarray, square: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest, ties to smaller ids."""
    return np.lexsort((ids, square))[:k]


def neighbours(df: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 10,
               window: float = WINDOW) -> DataFrame:
    """(query_id, rank, ``key``, score): for every row of ``queries`` the ``k`` nearest rows of ``df`` found, by Euclidean
    distance in double precision, nearest first, ties to the smaller key; rows with the query's own key are left out.

    Every row lies on ``CURVES`` Hilbert curves through random projections on shifted grids. A curve is cut into
    segments of equal share by the quantiles of a bounded sample, so a row's segment comes from its own key alone. A
    query meets the segments within ``window`` of its key on each curve. A row and a query that meet on several curves
    meet in one task only, that of the first such curve. Segments of any size are dealt out in pieces of about
    ``PIECE`` rows, queries in blocks of ``QUERIES``; each task returns its best ``k`` per query, and these are merged
    in two steps.

    The window is a share of all rows: on data without low-dimensional structure neighbours are spread over the curve
    in proportion to its length, and a fixed number of rows would lose recall as the table grows. It holds
    ``LEAST_ROWS`` on either side at least, so that a table of up to as many rows is compared whole.

    Vectors that are null, zero or non-finite take no part, nor do null keys. Vectors of different lengths have no
    distance; those of another length than most meet all others of their own length, dealt out like a segment. Repeated
    rows are candidates each. An empty table, or one without a usable query, gives no rows.
    """
    def good(rows: DataFrame) -> DataFrame:
        return rows.where(usable(vector) & F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    spark, shape = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows, asked = written(good(df), "points"), good(queries)
    sized = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sized is None:
        return spark.createDataFrame([], shape.replace("vec_id", key))
    usual, asked = sized["size"], written(asked, "queries")
    sample = rows.where(F.size("v") == usual).orderBy(F.xxhash64("id", "v"), "id").select("v").limit(SAMPLE).toPandas()
    curves = Curves.fit(np.array(sample["v"].tolist(), dtype=np.float64))
    reach = min(SEGMENTS, int(np.ceil(max(window, LEAST_ROWS / sized["count"]) * SEGMENTS)))
    others = rows.where(F.size("v") != usual).count()
    pieces = F.when(F.size("v") == usual, max(1, -(-sized["count"] // (SEGMENTS * PIECE)))).otherwise(
        max(1, -(-others // PIECE)))
    blocks = max(1, -(-asked.count() // QUERIES))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["v"].map(len) == usual
            # vectors of another length are all in one segment of one curve
            at = [np.zeros(1, dtype=np.int16)] * len(batch)
            x = np.array(batch["v"][known].tolist(), dtype=np.float64).reshape(-1, usual)
            for i, segments in zip(np.flatnonzero(known), curves.segments(x).astype(np.int16).T, strict=True):
                at[i] = segments
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "at": at})

    kind = f"id long, v {rows.schema['v'].dataType.simpleString()}, at array<short>"
    placed, looking = rows.mapInPandas(of, kind), asked.mapInPandas(of, kind)
    # a unit of work: one curve, one group of neighbouring segments, one piece of its rows, one block of queries
    group = F.floor(F.col("segment") / reach)
    base = placed.select("id", "v", "at", F.posexplode("at").alias("curve", "segment")).select(
        "id", "v", "at", F.lit(False).alias("asks"), "curve", group.alias("group"),
        F.pmod(F.xxhash64("id", "v"), pieces).alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    last = (SEGMENTS - 1) // reach
    asks = looking.select("id", "v", "at", F.posexplode("at").alias("curve", "segment")).select(
        "id", "v", "at", F.lit(True).alias("asks"), "curve",
        F.explode(F.sequence(F.greatest(F.lit(0), group - 1), F.least(F.lit(last), group + 1))).alias("group"),
        F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        curve, is_query = int(group["curve"].iloc[0]), group["asks"].to_numpy(bool)
        q, c = group[is_query], group[~is_query]
        out = []
        if len(q) and len(c):
            x, y = (np.array(part["v"].tolist(), dtype=np.float64) for part in (q, c))
            ids, at = c["id"].to_numpy(), np.array(c["at"].tolist(), dtype=np.int16)
            for n, (own, asked_at) in enumerate(zip(q["id"], q["at"], strict=True)):
                near = np.abs(at - np.asarray(asked_at, dtype=np.int16)) <= reach
                mine = np.flatnonzero(near[:, curve] & ~near[:, :curve].any(1) & (ids != own))
                if len(mine):
                    square = ((y[mine] - x[n]) ** 2).sum(1)
                    best = _nearest(ids[mine], square, k)
                    out.append(pd.DataFrame({"query_id": own, "id": ids[mine][best], "square": square[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "square": []})

    found = base.union(asks).groupBy(F.size("v"), "curve", "group", "piece", "block").applyInPandas(
        search, "query_id long, id long, square double")
    found = written(found, "found")
    best = F.slice(F.array_sort(F.collect_list(F.struct("square", "id"))), 1, k)
    part = F.pmod(F.xxhash64("id"), F.lit(16))
    first = found.groupBy("query_id", part.alias("part")).agg(best.alias("best")).select(
        "query_id", F.explode("best").alias("x")).select("query_id", "x.*")
    merged = first.groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(key), F.sqrt("x.square").alias("score"))
