"""Near-duplicate vectors: product quantisation with coarse lists, table-lookup distances, exact cosine at the end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.graph import components
from casebook.llm.store import forget, written

COSINE = 0.95
SAMPLE = 20_000  # the index is fitted on at most so many vectors, the first by hash
PARTS, CODES = 8, 64  # subspaces of a residual and codewords in each
PER_LIST = 400  # vectors meant for a coarse list
MOST_LISTS = 4096
BLOCK = 1000  # vectors compared with each other in one task


def unit_rows(vectors, dims: int | None = None) -> np.ndarray:
    """Vectors as rows of length 1; zeros stand for what a shorter one lacks of ``dims`` components."""
    if dims is None or all(len(v) == dims for v in vectors):
        x = np.array(list(vectors), dtype=np.float64).reshape(len(vectors), -1)
    else:
        x = np.zeros((len(vectors), dims))
        for row, v in zip(x, vectors, strict=True):
            row[: len(v)] = v
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def usable(vector: str = "embedding"):
    """Whether a vector is there, not zero, and has neither null nor non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        ranked = near[order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        sizes = np.diff(np.append(starts, len(x)))
        centres[ranked[starts]] = np.add.reduceat(x[order], starts, axis=0) / sizes[:, None]
    return centres


@dataclass
class Index:
    """Coarse centres, and codewords (part, code, values) of the residuals' subspaces."""

    centres: np.ndarray
    words: np.ndarray
    edges: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n_vectors: int) -> Index:
        lists = int(max(1, min(len(x), MOST_LISTS, n_vectors // PER_LIST)))
        centres = kmeans(x, lists)
        near = cls._nearest(x, centres)
        residual = x - centres[near]
        edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        widest, k = int(np.diff(edges).max()), min(CODES, len(x))
        words = np.zeros((len(edges) - 1, k, widest))
        for m, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            words[m, :, : b - a] = kmeans(residual[:, a:b], k)
        return cls(centres, words, edges)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres ** 2).sum(1)[None] - 2 * x @ centres.T, axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes stand for."""
        residual = x - self.centres[lists]
        codes = np.empty((len(x), len(self.words)), dtype=np.int64)
        error = np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            part, words = residual[:, a:b], self.words[m, :, : b - a]
            codes[:, m] = self._nearest(part, words)
            error += ((part - words[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and the other lists that it visits to meet vectors within ``radius``.

        A vector nearest to another centre lies beyond the plane midway between the two centres. The way between two
        vectors crosses it, so their distances to it sum to ``radius`` at most, and one of them is no more than half of
        that: it visits the other's list. ``meets`` tells which one.
        """
        square = (x ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1)[None] - 2 * x @ self.centres.T
        own = np.argmin(square, axis=1)
        # one row of centre distances per list that occurs, never rows × centres × components
        lists, of = np.unique(own, return_inverse=True)
        between = np.stack([np.sqrt(((self.centres[a] - self.centres) ** 2).sum(-1)) for a in lists])[of.reshape(-1)]
        near = square - square[np.arange(len(x)), own][:, None] <= radius * between + 1e-9
        near[np.arange(len(x)), own] = False
        return own, [np.flatnonzero(row) for row in near]

    def meets(self, x: np.ndarray, y: np.ndarray, here: int, other: np.ndarray) -> np.ndarray:
        """Whether the pairs of vectors, one at home ``here`` and one of the list ``other``, meet here and not there.

        They meet where the midpoint between them is, so the one nearer to the plane has come. Both tasks compute the
        same numbers in the same order.
        """
        low, high = np.minimum(here, other), np.maximum(here, other)
        way = self.centres[high] - self.centres[low]
        square = (self.centres ** 2).sum(1)
        in_low = np.einsum("ij,ij->i", x + y, way) <= square[high] - square[low]
        return in_low == (low == here)

    def table_distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of residual queries to coded residuals, summed from one table per query and part."""
        out = np.zeros((len(queries), len(codes)))
        for m, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            part, words = queries[:, a:b], self.words[m, :, : b - a]
            table = (part ** 2).sum(1)[:, None] + (words ** 2).sum(1)[None] - 2 * part @ words.T
            out += table[:, codes[:, m]]
        return np.maximum(out, 0)


def _compare(group: pd.DataFrame, index: Index, cosine: float) -> pd.DataFrame:
    """Links found between two blocks of a list: per vector the weight of its links, and a forest of edges."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    first, second, lists = int(group["i"].iloc[0]), int(group["j"].iloc[0]), int(group["list"].iloc[0])
    group = group.sort_values("node").reset_index(drop=True)
    x, block = unit_rows(group["vector"], index.centres.shape[1]), group["block"].to_numpy()
    sizes = group["vector"].map(len).to_numpy()
    codes, error = index.encode(x, np.full(len(x), lists))
    residual = x - index.centres[lists]
    nodes, copies, own = (group[c].to_numpy() for c in ("node", "copies", "own"))
    links, root, edges = np.zeros(len(x), np.int64), list(range(len(x))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        far = index.table_distances(residual[rows], codes[right])
        # by the triangle inequality this drops no pair within the radius
        maybe = np.sqrt(far) <= radius + error[right][None] + 1e-6
        if first == second:
            maybe &= rows[:, None] < right[None]
        a, b = np.nonzero(maybe)
        a, b = rows[a], right[b]
        for part in range(0, len(a), 200_000):
            p, q = a[part:part + 200_000], b[part:part + 200_000]
            alike = (np.einsum("ij,ij->i", x[p], x[q]) >= cosine) & (sizes[p] == sizes[q])
            p, q = p[alike], q[alike]
            away = np.where(own[p] == lists, own[q], own[p])
            here = (away == lists) | index.meets(x[p], x[q], lists, away)
            p, q = p[here], q[here]
            links += np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
            for u, v in zip(p, q, strict=True):
                ru, rv = find(u), find(v)
                if ru != rv:
                    root[max(ru, rv)] = min(ru, rv)
                    edges.append((nodes[u], nodes[v]))
    met = np.flatnonzero(links)
    return pd.concat([pd.DataFrame({"a": nodes[met], "b": pd.array([None] * len(met), dtype="Int64"), "n": links[met]}),
                      pd.DataFrame({"a": pd.array([e[0] for e in edges], dtype="Int64"),
                                    "b": pd.array([e[1] for e in edges], dtype="Int64"), "n": 0})], ignore_index=True)


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = COSINE,
                    slack: float = 1.0) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_links`` (other rows of cosine ``cosine`` or more), ``component_id``
    (smallest key reachable by links), ``kept`` (one row per component).

    Equal vectors are one node with a number of copies. The index is fitted on a bounded sample; every vector is in
    the list of its nearest centre and visits each other list whose border is within half the distance that ``cosine``
    allows, times ``slack``: of two linked vectors in different lists one is that near to the border between them. At 1 no
    link is lost; less than 1 is faster and loses some. A list's vectors are cut into blocks of ``BLOCK`` and each pair of
    blocks is a group, so a list of any size spreads; only counts and a forest of edges leave a task. Table distances
    with each code's own error drop no link, and the cosine of the survivors is computed in double precision.

    Null, zero or non-finite vectors link with nothing, nor do vectors of different lengths with each other; a shorter one
    is filled with zeros, which changes no cosine among those of its length. Rows with a null key take part. Repeated rows link with each other. An empty table gives no rows.
    """
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    rows = written(df.select(F.col(key).alias("key"), F.when(usable(vector), F.col(vector)).alias("vector"),
                             F.monotonically_increasing_id().alias("row")), "vectors")
    sized = rows.where("vector is not null").agg(F.max(F.size("vector")).alias("dims"), F.count("*").alias("count")).first()
    dims = sized["dims"]
    empty = rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"),
                        F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    if dims is None:
        return empty
    least = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row").alias("row")))
    nodes = written(rows.where("vector is not null").groupBy("vector").agg(
        least.alias("least"), F.count("*").alias("copies"), F.min("row").alias("node")), "nodes")
    sample = nodes.orderBy(F.xxhash64("vector"), "node").select("vector").limit(SAMPLE).toPandas()
    index = Index.fit(unit_rows(sample["vector"], dims), sized["count"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.iloc[at:at + 500]
                own, others = index.probes(unit_rows(batch["vector"], dims), radius * slack)
                lists = [np.append(o, p) for o, p in zip(own, others, strict=True)]
                yield pd.DataFrame({"node": batch["node"], "copies": batch["copies"], "own": own, "lists": lists})

    placed = written(nodes.select("node", "copies", "vector").mapInPandas(
        place, "node long, copies long, own int, lists array<int>"), "placed")
    home = F.col("own") == F.col("list")
    spread = placed.select("node", "copies", "own", F.explode("lists").alias("list")).withColumn("home", home)
    blocks = [F.ceil(F.count_if(c) / BLOCK).cast("int") for c in (F.col("home"), ~F.col("home"))]
    sizes = spread.groupBy("list").agg(blocks[0].alias("homes"), blocks[1].alias("guests"))
    # vectors at home are compared with each other and with the guests that probe the list, guests not among themselves
    dealt = spread.join(F.broadcast(sizes), "list")
    at = F.xxhash64("node", "list")
    block = F.when(F.col("home"), F.pmod(at, F.col("homes"))).otherwise(F.col("homes") + F.pmod(at, F.col("guests")))
    last = F.when(F.col("home"), F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1
    pairs = dealt.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "list", "own", "node", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = written(pairs.join(nodes.select("node", "vector"), "node").groupBy("list", "i", "j").applyInPandas(
        lambda g: _compare(g, index, cosine), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"), "vectors-cc")
    member = nodes.join(counts, "node", "left").join(roots.withColumnRenamed("a", "node"), "node", "left").select(
        "vector", "least", F.coalesce("root", "node").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = member.groupBy("root").agg(F.min("least").alias("first"))
    named = written(member.join(classes, "root").select("vector", "n_links", F.col("first.key").alias("component"),
                                                        F.col("first.row").alias("first")), "vector-classes")
    forget(placed)
    alone = F.col("first").isNull()
    return rows.join(named, "vector", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("key")).otherwise(F.col("component")).alias("component_id"),
        (alone | (F.col("row") == F.col("first"))).alias("kept"))
