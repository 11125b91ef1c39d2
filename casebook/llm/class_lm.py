"""Language-model scores from a class-based bigram model (Brown et al. 1992) with exchange clustering.

A text's probability is the product, over its words and its end, of a transition from the class of the token before to
the token's own class, and of the token given its class. The classes come from the exchange algorithm of Kneser and Ney
in its parallel form: in each round a share of the frequent words looks, against the counts of the round before, for the class
that raises the likelihood of the training text most.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.store import forget, small_batches, written

CLASSES = 96  # that words are exchanged between
EXCHANGED = 1e-5  # words with at least this share of all tokens are exchanged, so at most 100,000 of any corpus
CARRIED = 1e-6  # words with at least this share are looked up in every task, at most 1,000,000; the others are joined
ROUNDS = 16
SHARE = 0.5  # of the words that are judged in a round, as long as the likelihood rises
PRIOR = 20.0  # counts of a class's successors are mixed with so many draws from the classes' own frequencies
HELD_WORDS = 400_000  # different words that a task counts before it hands them on
HELD_TOKENS = 2_000_000  # tokens that a task holds before it counts their pairs
LETTERS = 26
#: Classes by spelling, for words that are not exchanged: digits only, some digit, last letter, anything else.
RULES = LETTERS + 3


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case (A to Z) words between white space of ASCII."""
    return (text or b"").lower().split()


def rule(word: bytes) -> int:
    if word.isdigit():
        return 0
    if len(word.translate(None, b"0123456789")) < len(word):
        return 1
    last = word[-1] - 97
    return 2 + last if 0 <= last < LETTERS else RULES - 1


def _texts(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        yield batch, [tokens(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, rule, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            words = list(counts)
            return pa.RecordBatch.from_arrays([
                pa.array(words, pa.binary()).cast(pa.string()), pa.array(map(rule, words), pa.int32()),
                pa.array(counts.values(), pa.int64())], names=["word", "rule", "n"])

        for _, texts in _texts(batches):
            for words in texts:
                counts.update(words)
                if len(counts) >= HELD_WORDS:
                    yield flush()
                    counts.clear()
        yield flush()

    parts = small_batches(docs.select(text)).mapInArrow(count, "word string, rule int, n long")
    return parts.groupBy("word", "rule").agg(F.sum("n").alias("n"))


class _Symbols(dict):
    """Number of a word among the exchanged ones, or after these that of its spelling rule."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.first = len(words)

    def __missing__(self, word: bytes) -> int:
        number = self.first + rule(word)
        if len(self) < self.first + HELD_WORDS // 2 and len(word) <= 64:
            self[word] = number
        return number


def count_pairs(docs: DataFrame, text: str, words: list[bytes]) -> DataFrame:
    """(left, right, n): how often a symbol follows another, the end of a text both before its first word and after its
    last. Symbols are the exchanged words, then the spelling rules, then the end."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    size = len(words) + RULES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = _Symbols(sent.value), [size - 1]

        def flush():
            at = np.array(held, dtype=np.int64)
            codes, n = np.unique(at[:-1] * size + at[1:], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes // size, pa.int32()), pa.array(codes % size, pa.int32()),
                                               pa.array(n, pa.int64())], names=["left", "right", "n"])

        for _, texts in _texts(batches):
            for words in texts:
                held.extend(map(number.__getitem__, words))
                held.append(size - 1)
                if len(held) >= HELD_TOKENS:
                    yield flush()
                    held = [size - 1]
        yield flush()

    parts = small_batches(docs.select(text)).mapInArrow(count, "left int, right int, n long")
    return parts.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _contexts(pairs: DataFrame) -> DataFrame:
    """Per symbol, the symbols after it and before it with their counts; lists no longer than there are symbols."""
    both = pairs.select(F.col("left").alias("symbol"), F.col("right").alias("other"), "n", F.lit(True).alias("after"))
    both = both.unionAll(pairs.select(F.col("right").alias("symbol"), F.col("left").alias("other"), "n", F.lit(False)))
    lists = [F.collect_list(F.when(F.col("after") == side, F.col(c))).alias(f"{name}_{c}")
             for name, side in (("next", True), ("last", False)) for c in ("other", "n")]
    return both.groupBy("symbol").agg(*lists)


def _by_class(batch: pa.RecordBatch, name: str, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """(rows, classes) counts of a batch's neighbours on one side."""
    other, n = batch.column(f"{name}_other"), batch.column(f"{name}_n")
    row = np.repeat(np.arange(batch.num_rows), other.value_lengths().to_numpy(zero_copy_only=False))
    at = classes[other.flatten().to_numpy(zero_copy_only=False)]
    weights = n.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.bincount(row * n_classes + at, weights, batch.num_rows * n_classes).reshape(-1, n_classes)


def transitions(contexts: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often a class follows another."""
    sent = contexts.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes, n_classes))
        for batch in batches:
            np.add.at(total, sent.value[batch.column("symbol").to_numpy()],
                      _by_class(batch, "next", sent.value, n_classes))
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                          pa.array(total[a, b].astype(np.int64))], names=["a", "b", "n"])

    found = contexts.select("symbol", "next_other", "next_n").mapInArrow(add, "a int, b int, n long")
    out = np.zeros((n_classes, n_classes))
    for a, b, n in found.groupBy("a", "b").agg(F.sum("n")).collect():
        out[a, b] = n
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(counts: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float, choices: int) -> int:
    """The class in which a word makes the training text likeliest, its own one at a tie.

    ``counts`` are class transitions with the word in class ``own``; ``after`` and ``before`` the counts of the classes
    that follow and precede the word, its own repetitions (``itself``) in both. The likelihood is, but for a constant,
    the sum of f(x) = x log x over transitions less that over the totals of classes on either side.
    """
    after, before = after.copy(), before.copy()
    after[own] -= itself
    before[own] -= itself
    rest = counts.copy()
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] -= itself
    gain = np.zeros(choices)
    here = np.arange(choices)
    for side, other, table in ((after, before, rest), (before, after, rest.T)):
        at = np.flatnonzero(side)
        part = _f(table[:choices, at] + side[at]) - _f(table[:choices, at])
        inside = at < choices
        part[at[inside], np.flatnonzero(inside)] = 0  # a class's transitions to itself change from both sides
        total = (table.sum(1) + other)[:choices]  # neighbours keep the word beside them, wherever it goes
        gain += part.sum(1) - _f(total + side.sum() + itself) + _f(total)
    loop = rest[here, here]
    gain += _f(loop + after[:choices] + before[:choices] + itself) - _f(loop)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-6 else own


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of the training text under its class transitions, less what no choice of classes changes."""
    return float(_f(counts).sum() - _f(counts.sum(0)).sum() - _f(counts.sum(1)).sum())


def exchange(contexts: DataFrame, n_words: int, n_classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of every symbol, and the transitions between classes.

    Words, numbered by falling frequency, start in turn in each class. In every round a share of the words, drawn by a
    hash of word and round, is judged against the same counts, and all of these move at once. A round after which the
    likelihood is no higher is taken back and the share falls to a quarter; so it never falls, and the outcome depends
    on the counts alone. Rules and the end have classes of their own, after the ``n_classes`` of words.
    """
    every = n_classes + RULES + 1
    classes = np.concatenate([np.arange(n_words) % max(1, n_classes), n_classes + np.arange(RULES + 1)]).astype(np.int64)
    spark = contexts.sparkSession
    counts, share = transitions(contexts, classes, every), SHARE
    for turn in range(rounds if n_words > 1 and n_classes > 1 else 0):
        drawn = np.array([zlib.crc32(b"%d %d" % (w, turn)) < share * 2 ** 32 for w in range(n_words)])
        sent = spark.sparkContext.broadcast((classes, counts, drawn))

        def judge(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            classes, counts, drawn = sent.value
            moved: list[tuple[int, int]] = []
            for batch in batches:
                symbols = batch.column("symbol").to_numpy()
                batch = batch.filter(pa.array(drawn[symbols]))
                after, before = (_by_class(batch, name, classes, every) for name in ("next", "last"))
                for i, symbol in enumerate(batch.column("symbol").to_pylist()):
                    other = batch.column("next_other")[i].values.to_numpy()
                    at = np.flatnonzero(other == symbol)
                    itself = float(batch.column("next_n")[i].values.to_numpy()[at[0]]) if len(at) else 0.0
                    to = best_class(counts, classes[symbol], after[i], before[i], itself, n_classes)
                    if to != classes[symbol]:
                        moved.append((symbol, to))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moved], pa.int32()) for i in (0, 1)],
                                             names=["symbol", "class"])

        moved = contexts.where(F.col("symbol") < n_words).mapInArrow(judge, "symbol int, class int").toArrow()
        tried = classes.copy()
        tried[moved.column("symbol").to_numpy()] = moved.column("class").to_numpy()
        found = transitions(contexts, tried, every) if moved.num_rows else counts
        if likelihood(found) > likelihood(counts):
            classes, counts = tried, found
        elif moved.num_rows:
            share /= 4
    return classes, counts


@dataclass
class Model:
    """Counts of all training words as a table; what every task needs, in logarithms to base 10."""

    words: DataFrame  # (word, n) of all training words
    n_tokens: int
    n_types: int
    n_ends: int
    carried: list[bytes]  # frequent words
    log_count: np.ndarray  # log10(n + 0.5) of these, then of an unknown word, then of the end
    classes: np.ndarray  # class of these, then of each rule, then of the end
    log_word: np.ndarray  # log10 probability in its class of these; of a rule what log10(n + 0.5) must be added to; of the end
    log_step: np.ndarray  # class after class
    base: float  # log10 of the base model's denominator


def train(docs: DataFrame, text: str = "text", n_classes: int = CLASSES) -> Model:
    """A model of all texts of ``docs``; null counts as empty.

    Counted over all words: frequencies (a table in the shared folder), transitions of classes. The driver and the tasks
    get the words above ``CARRIED`` and the neighbours' classes of those above ``EXCHANGED``, shares that bound their
    number. Other words are in classes by spelling, each with room for unseen words.
    """
    words = written(count_words(docs, text), "words")
    sizes = words.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    ends = docs.count()
    n_tokens, n_types = (sizes["n"] or 0) + ends, sizes["types"] + (ends > 0)
    top = words.where(F.col("n") >= CARRIED * n_tokens).orderBy(F.desc("n"), "word").toArrow()
    carried = top.column("word").cast(pa.binary()).to_pylist()
    n, rules = (top.column(c).to_numpy().astype(np.float64) for c in ("n", "rule"))
    n_words = int((n >= EXCHANGED * n_tokens).sum())
    n_classes = max(1, min(n_classes, n_words))
    pairs = written(count_pairs(docs, text, carried[:n_words]), "pairs")
    contexts = written(small_batches(_contexts(pairs)), "contexts")
    classes, counts = exchange(contexts, n_words, n_classes)
    forget(pairs, contexts)
    rare = words.where(F.col("n") < EXCHANGED * n_tokens) if n_words else words
    sums = {r["rule"]: (r["n"], r["types"]) for r in rare.groupBy("rule").agg(
        F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    room = np.array([sums.get(r, (0, 0))[0] + 0.5 * (sums.get(r, (0, 0))[1] + 1) for r in range(RULES)])
    total = np.bincount(classes[:n_words], n[:n_words], n_classes)
    own = classes[:n_words]
    in_rule = rules[n_words:].astype(np.int64)
    log_word = np.concatenate([np.log10(n[:n_words]) - np.log10(total[own]),
                               np.log10(n[n_words:] + 0.5) - np.log10(room[in_rule]), -np.log10(room), [0.0]])
    every = n_classes + RULES + 1
    share = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * every)
    step = np.log10((counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR))
    return Model(words.select("word", "n"), n_tokens, n_types, ends, carried,
                 np.log10(np.concatenate([n, np.zeros(RULES), [ends]]) + 0.5),
                 np.concatenate([own, n_classes + in_rule, n_classes + np.arange(RULES + 1)]), log_word, step,
                 float(np.log10(n_tokens + 0.5 * (n_types + 1))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "lm") -> DataFrame:
    """The other columns of ``docs`` and a struct ``out``: n_tokens, n_known (tokens seen in training), base (log10
    probability under smoothed word frequencies), score (under the class model) and perplexity (of the class model).

    Whole texts, null as empty; a column named like ``out`` is replaced. One pass scores all words that tasks carry;
    other words of a text go, counted, to the table of training words and come back as two sums per row.
    """
    rest = [c for c in docs.columns if c not in (text, out)]
    rows = small_batches(docs.select(F.col(f"`{text}`").alias("text"), F.struct(
        *[F.col(f"`{c}`") for c in rest] or [F.lit(None).cast("boolean").alias("none")]).alias("row")))
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.carried, model.log_count, model.classes, model.log_word, model.log_step))
    n_carried, no_end = len(model.carried), int(model.n_ends == 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, log_count, classes, log_word, log_step = sent.value
        number, end = _Symbols(words), len(words) + RULES
        made = 0
        for batch, texts in _texts(batches):
            if not texts:
                continue
            sizes = np.array([len(t) + 1 for t in texts])
            flat: list[int] = []
            for t in texts:
                flat.extend(map(number.__getitem__, t))
                flat.append(end)
            at = np.array(flat, dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            before = np.empty_like(at)
            before[1:] = at[:-1]
            before[starts] = end
            carried = (at < n_carried) | (at == end)
            value = log_word[at] + log_step[classes[before], classes[at]]
            known = carried.astype(np.int64)
            known[at == end] -= no_end
            sums = [np.add.reduceat(x, starts) for x in (known, np.where(carried, log_count[at], 0.0), value)]
            others, times, ends = [], [], [0]
            places, first = np.flatnonzero(~carried), 0
            for words_of, start, last in zip(texts, starts, np.cumsum(~carried)[starts + sizes - 1], strict=True):
                seen = Counter([words_of[p] for p in (places[first:last] - start).tolist()])
                others.extend(seen)
                times.extend(seen.values())
                ends.append(len(others))
                first = last
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(others, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.arange(made, made + len(texts))), pa.array(sizes, pa.int64()),
                 *[pa.array(s) for s in sums], lists],
                names=["row", "number", "n_tokens", "known", "base", "score", "others"])
            made += len(texts)

    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(of, f"row {kind}, number long, n_tokens long, known long, base double, score double, "
                               "others array<struct<word string, times long>>")
    done = written(done.withColumn("task", F.spark_partition_id()), "scored")
    asked = done.select("task", "number", F.inline("others"))
    seen = F.col("n").isNotNull()
    answers = asked.join(model.words, "word", "left").groupBy("task", "number").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("added"))
    both = done.drop("others").join(answers, ["task", "number"], "left")
    added = F.coalesce("added", F.lit(0.0))
    full = F.col("score") + added
    result = F.struct("n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      (F.col("base") + added - F.col("n_tokens") * F.lit(model.base)).alias("base"), full.alias("score"),
                      F.pow(F.lit(10.0), -full / F.col("n_tokens")).alias("perplexity"))
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], result.alias(out))
