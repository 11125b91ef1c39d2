"""Document quality: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.store import small_batches, written

DIM = 32  # length of every vector
WORD_SLOTS, SHAPE_SLOTS = 8192, 1024  # words and shapes are hashed to so many vectors
SLOTS = WORD_SLOTS + SHAPE_SLOTS
NONZERO = 4  # entries of an index vector that are +1 or -1
REACH = 2  # words on either side that make up a word's context
HIDDEN = 32
TRAIN_ROWS = 20_000  # the network is fitted on at most so many labelled documents
CACHED_WORDS = 150_000
CHUNK = 100_000  # words handled at once


class _Slots(dict):
    """A word's two slots: its letters in lower case, and its shape (case and the marks around it), as one number."""

    def __missing__(self, word: str) -> int:
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        at = word.find(core) if core else 0
        case = ("-" if not core else "u" if core.isupper() and len(core) > 1 else "l" if core.islower()
                else "t" if core.istitle() else "d" if core.isdigit() else "m")
        shape = f"{word[:at][:3]}{case}{word[at + len(core):][:3]}" if core else f"{word[:3]}-"
        slot = (zlib.crc32(core.lower().encode("utf-8", "replace")) % WORD_SLOTS) * SHAPE_SLOTS
        slot += zlib.crc32(shape.encode("utf-8", "replace")) % SHAPE_SLOTS
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = slot
        return slot


def index_vectors() -> np.ndarray:
    """A sparse random vector for every slot, and a zero row for gaps between documents."""
    rng = np.random.default_rng(7)
    out = np.zeros((SLOTS + 1, DIM), dtype=np.int8)
    for row in out[:-1]:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], text: str, gap: int):
    """(batch, first row, word slots, shape slots, words per row) of about ``CHUNK`` words, rows kept whole."""
    known = _Slots()
    for batch in batches:
        texts, first, slots, sizes, total = batch.column(text), 0, [], [], 0
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").split()
            slots.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
            sizes.append(len(words))
            total += len(words)
            if total >= CHUNK or i == batch.num_rows - 1:
                pad = np.full(gap, -1)
                flat = np.concatenate([x for s in slots for x in (s, pad)]) if gap else np.concatenate(slots)
                inside = flat >= 0
                yield (batch, first, np.where(inside, flat // SHAPE_SLOTS, SLOTS),
                       np.where(inside, flat % SHAPE_SLOTS + WORD_SLOTS, SLOTS), np.array(sizes))
                first, slots, sizes, total = i + 1, [], [], 0


def _add_by_slot(sums: np.ndarray, slots: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(slots, kind="stable")
    ranked = slots[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sums[ranked[starts]] += np.add.reduceat(values[order], starts, axis=0, dtype=np.int64)


def context_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """(slot, c0, c1, ...): over all documents, the index vectors of each word's neighbours, added up as integers.

    A task adds up its own rows in a table of fixed size and gives one row per slot it met; the rest is one
    aggregation on ``slot``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        sums = np.zeros((SLOTS + 1, DIM), dtype=np.int64)
        for _, _, words, shapes, _ in _chunks(batches, text, REACH):
            signal = index[words] + index[shapes]
            around = np.zeros(signal.shape, dtype=np.int16)
            for d in range(1, REACH + 1):
                around[d:] += signal[:-d]
                around[:-d] += signal[d:]
            _add_by_slot(sums, words, around)
            _add_by_slot(sums, shapes, around)
        met = np.flatnonzero(np.any(sums[:SLOTS], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(sums[met, j]) for j in range(DIM)]],
                                         names=["slot", *[f"c{j}" for j in range(DIM)]])

    parts = small_batches(docs.select(text)).mapInArrow(run, "slot long, " + ", ".join(f"c{j} long" for j in range(DIM)))
    return parts.groupBy("slot").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(DIM)])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors, ``SLOTS`` + 1 rows of fixed length, so their size does not depend on the corpus."""
    found = written(context_sums(docs, text), "contexts").toPandas().to_numpy(dtype=np.float64)
    out = np.zeros((SLOTS + 1, DIM))
    out[found[:, 0].astype(int)] = found[:, 1:]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms > 0, norms, 1)).astype(np.float32)


WIDTH = 2 * DIM + 3


def _pooled(vectors: np.ndarray, words: np.ndarray, shapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: mean word vector, mean shape vector, both lengths, and the logarithm of the number of words."""
    out = np.zeros((len(sizes), WIDTH), dtype=np.float64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for j, slots in enumerate((words, shapes)):
            mean = np.add.reduceat(vectors[slots], starts, axis=0, dtype=np.float64) / sizes[full, None]
            out[full, j * DIM:(j + 1) * DIM] = mean
            out[full, 2 * DIM + j] = np.linalg.norm(mean, axis=1)
    out[:, -1] = np.log1p(sizes) / 10
    return out


@dataclass
class Network:
    """Two layers and a temperature; ``constant`` is the score where there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float = 1.0
    constant: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on cross-entropy over four fifths of the rows; the rest sets the temperature that fits its labels best.

    Rows must come in a fixed order. With fewer than ten rows or one class, the score is the share of label 1.
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    scale = np.where(scale > 1e-9, scale, 1.0)
    if len(y) < 10 or y.min() == y.max():
        return Network(mean, scale, None, constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5:]
    params = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN),
              rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * params[0], back.sum(0), h.T @ error + decay * params[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, (params[0], params[1], params[2], float(params[3])))
    logits, target = net.logits(x[held]), y[held]
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in tried]
    net.temperature = float(tried[int(np.argmin(loss))])
    return net


def _map_rows(docs: DataFrame, text: str, schema: str, name: str, per_chunk) -> DataFrame:
    """``docs`` without ``text`` and with a column made from each document's words."""
    rest = [c for c in docs.columns if c not in (text, name)]
    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, words, shapes, sizes in _chunks(batches, text, 0):
            part = batch.slice(first, len(sizes))
            columns = [part.column(part.schema.names.index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, per_chunk(words, shapes, sizes)], names=[*rest, name])

    return small_batches(docs.select(*rest, text)).mapInArrow(run, fields)


def train(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS):
    """(word vectors, network) from all documents and from ``labelled`` (key, label 0 or 1).

    At most ``rows`` labelled keys, the first by hash, are joined to the documents; the join side is bounded by that.
    A key with several labels gets the more frequent, 1 at a tie; null keys and labels are left out.
    """
    vectors = word_vectors(docs, text)
    votes = labelled.where(F.col(key).isNotNull() & F.col("label").isNotNull()).groupBy(key).agg(
        (F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    chosen = votes.orderBy(F.xxhash64(key), key).limit(rows)
    sample = docs.select(key, text).join(F.broadcast(chosen), key)

    def pool(words, shapes, sizes):
        return pa.array(list(_pooled(vectors, words, shapes, sizes)), pa.list_(pa.float64()))

    pooled = _map_rows(sample, text, "pooled array<double>", "pooled", pool).dropDuplicates([key]).orderBy(
        F.xxhash64(key), key).select("pooled", "label").toPandas()
    x = np.stack(pooled["pooled"].to_numpy()) if len(pooled) else np.zeros((0, WIDTH))
    return vectors, fit(x, pooled["label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """The other columns of ``docs`` and a score between 0 and 1, higher the likelier label 1 is; no shuffle.

    Only the text counts. A null or empty text is scored too, as a document without words.
    """
    vectors, network = model

    def scores(words, shapes, sizes):
        return pa.array(network.scores(_pooled(vectors, words, shapes, sizes)))

    return _map_rows(docs, text, f"`{out}` double", out, scores)
