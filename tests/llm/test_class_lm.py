"""The class-based language model against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import class_lm

GROUPS = [["cat", "dog", "cow", "hen"], ["runs", "eats", "naps"], ["red", "big", "old"], ["quickly", "now"]]


def _texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(g) for _ in range(rng.randrange(1, 6)) for g in GROUPS) for _ in range(n)]


ODD = [None, "", " \t\n ", "Cat\x0bDOG\x0ccat", "éÉ   x y", "cat " * 20_000 + "zebra", "a1 22 zz? ünseen", "cat", "cat"]


def _plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def _likelihood(classes, texts, n_classes):
    """Of the classes' bigrams, by the definition."""
    pairs, left, right = Counter(), Counter(), Counter()
    for t in texts:
        at = [n_classes, *[classes[w] for w in t], n_classes]
        pairs.update(zip(at, at[1:]))
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    f = lambda x: x * math.log(x) if x else 0.0
    return sum(map(f, pairs.values())) - sum(map(f, left.values())) - sum(map(f, right.values()))


def test_best_class_is_the_best_by_the_definition():
    rng = random.Random(2)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    texts += [["a", "a", "b"]] * 9
    k = 3
    classes = {w: rng.randrange(k) for w in "abcdefgh"}
    counts = np.zeros((k + 1, k + 1))
    for t in texts:
        at = [k, *[classes[w] for w in t], k]
        for a, b in zip(at, at[1:]):
            counts[a, b] += 1
    for w in "abcdefgh":
        after, before, itself = np.zeros(k + 1), np.zeros(k + 1), 0
        for t in texts:
            for a, b in zip([None, *t], [*t, None]):
                if a == w:
                    after[k if b is None else classes[b]] += 1
                if b == w:
                    before[k if a is None else classes[a]] += 1
                itself += a == b == w
        tried = [_likelihood(classes | {w: c}, texts, k) for c in range(k)]
        best = int(np.argmax(tried))
        expected = best if tried[best] > tried[classes[w]] + 1e-6 else classes[w]
        assert class_lm.best_class(counts, classes[w], after, before, itself, k) == expected


@pytest.fixture
def model(spark):
    docs = spark.createDataFrame([(t,) for t in [*_texts(300), *ODD]], "text string").repartition(3)
    return class_lm.train(docs, n_classes=5)


def test_counts_and_base_score(spark, model, monkeypatch):
    train = [*_texts(300), *ODD]
    counts = Counter(w for t in train for w in [*_plain(t), None])
    n, types = sum(counts.values()), len(counts)
    asked = [*_texts(20, seed=9), *ODD, "never seen words never"]
    rows = [(i, t, i, "x") for i, t in enumerate(asked)]
    found = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string, row int, lm string").repartition(2), model)
    assert found.columns == ["doc_id", "row", "lm"] and found.count() == len(rows)
    for r in found.collect():
        words = [*_plain(asked[r["doc_id"]]), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (types + 1))) for w in words)
        lm = r["lm"]
        assert (lm["n_tokens"], lm["n_known"], model.n_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert lm["base"] == pytest.approx(base, rel=1e-9)
        assert lm["perplexity"] == pytest.approx(10 ** (-lm["score"] / len(words)), rel=1e-9)


def test_score_is_a_probability_and_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "EXCHANGED", 0.01)  # so that words of all three kinds occur
    monkeypatch.setattr(class_lm, "CARRIED", 0.0003)
    train = [*_texts(300), *(t for t in ODD if not t or len(t) < 99), *[f"{c}x{i % 7}y{c}" for i in range(60) for c in "ab"],
             "one two three four five six seven eight nine ten 1 2 3 1a 2b"]
    model = class_lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(2), n_classes=4)
    carried = [w.decode() for w in model.carried]
    counts = {r["word"]: r["n"] for r in model.words.collect()}
    every = len(model.log_step)
    n_words = sum(c < 4 for c in model.classes[:len(carried)])
    assert 0 < n_words < len(carried) < len(counts)
    assert np.allclose((10 ** model.log_step).sum(1), 1)
    of = dict(zip(carried, model.classes.tolist()))
    kind = {w: of.get(w, 4 + class_lm.rule(w.encode())) for w in counts}
    total, types = Counter(), Counter()
    for w, c in kind.items():
        total[c] += counts[w]
        types[c] += 1

    def given(w):
        c = kind.get(w, 4 + class_lm.rule(w.encode()))
        if c < 4:
            return c, counts[w] / total[c]
        return c, (counts.get(w, 0) + 0.5) / (total[c] + 0.5 * (types[c] + 1))

    for c in range(every - 1):  # all words of a class, and one place for those never seen
        mass = sum(given(w)[1] for w in counts if kind[w] == c) + (0.5 / (total[c] + 0.5 * (types[c] + 1)) if c >= 4 else 0)
        assert mass == pytest.approx(1) or c < 4 and not total[c]
    asked = [*_texts(5, 3), *ODD, "axaya zwei ax3ya ax3ya 1 99"]
    found = class_lm.score(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model).collect()
    for r in found:
        last, value = every - 1, 0.0
        for w in _plain(asked[r["i"]]):
            c, p = given(w)
            value += model.log_step[last, c] + math.log10(p)
            last = c
        value += model.log_step[last, every - 1]
        assert r["lm"]["score"] == pytest.approx(value, rel=1e-9)


def test_exchange_raises_the_likelihood_and_nears_the_groups(spark):
    texts = _texts(400)
    model = class_lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), n_classes=4)
    of = dict(zip([w.decode() for w in model.carried], model.classes.tolist()))
    start = {w: i % 4 for i, w in enumerate(of)}
    split = [_plain(t) for t in texts]
    found, first, groups = (_likelihood(c, split, 4) for c in (of, start, {w: i for i, g in enumerate(GROUPS) for w in g}))
    assert found > first + 0.8 * (groups - first)
    held = spark.createDataFrame([(t,) for t in _texts(50, 7)], "text string")
    lm = class_lm.score(held, model).agg(F.sum("lm.score").alias("s"), F.sum("lm.base").alias("b")).first()
    assert lm["s"] > lm["b"]


def test_partitions_do_not_show(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate([*_texts(80), *ODD])]
    df = spark.createDataFrame(texts, "i int, text string")
    one = class_lm.score(df.coalesce(1), class_lm.train(df.coalesce(1), n_classes=3)).orderBy("i").collect()
    monkeypatch.setattr(class_lm, "HELD_WORDS", 10)
    monkeypatch.setattr(class_lm, "HELD_TOKENS", 10)
    many = class_lm.score(df.repartition(7), class_lm.train(df.repartition(5), n_classes=3)).orderBy("i").collect()
    for a, b in zip(one, many, strict=True):
        assert a["lm"]["score"] == pytest.approx(b["lm"]["score"], rel=1e-9) and a["lm"]["n_known"] == b["lm"]["n_known"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "new words"), (2, None)], "doc_id long, text string")
    assert class_lm.score(none, class_lm.train(none)).count() == 0
    rows = {r["doc_id"]: r["lm"] for r in class_lm.score(some, class_lm.train(none)).collect()}
    assert rows[1]["n_known"] == rows[2]["n_known"] == 0 and rows[1]["n_tokens"] == 3 and rows[2]["n_tokens"] == 1
    assert rows[1]["base"] == 0.0 and rows[1]["score"] < 0  # (0 + 0.5) / (0 + 0.5) for every token
    blank = class_lm.train(some.where("doc_id = 2"))
    assert (blank.n_tokens, blank.n_types) == (1, 1)
    assert class_lm.score(some, blank).count() == 2
