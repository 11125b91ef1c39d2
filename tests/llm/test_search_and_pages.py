"""Near-duplicates, neighbours, pages, quality and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook.llm import curves, graph, neardup, pq_dedup, quality, site_tree, store
from casebook.llm.queries import QUERIES


def _components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, **{200 + i: 200 for i in range(1, 9)}}


def test_tables_noted_can_be_forgotten(spark):
    with store.tables_noted() as own:
        plain = store.written(spark.range(5), "noted")
        dealt = store.in_buckets(spark.range(5), "noted_too", "id")
    after = store.written(plain.union(dealt), "after")
    names = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_noted")]
    assert len(own) == 2 and after.count() == 10 and len(names()) == 1
    for _ in range(2):
        store.forget_paths(spark, own)
    folder = store.shared_folder(spark)
    left = [f.name for f in Path(folder.removeprefix("file:")).iterdir() if f.name.startswith("llm-noted")]
    assert after.count() == 10 and not left and not names()


def _texts():
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 40, 200]))] for _ in range(40)]
    out = []
    for words in base:
        out += [words, words]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(1000)}"
            out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("block", [800, 7])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = [*_texts(), None, "", "  \n ", "UPPER case  Words here now"]
    texts.append("upper case words here now")
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_texts long")
    words = neardup._Words()
    sets = [dict(zip(*(x.tolist() for x in neardup.shingles(t, words)), strict=True)) for t in texts]

    def alike(a, b):
        common = sum(min(n, b.get(k, 0)) for k, n in a.items())
        return common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) if a and b else False

    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    want = _components(len(texts), links)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert [i for i in got if got[i]["kept"]] and sum(r["kept"] for r in got.values()) == len(set(want))


@pytest.mark.parametrize("share", [3, 2])
def test_near_copies_of_a_large_group_link_whatever_its_size(spark, share):
    rng = random.Random(6)
    n, base = 3000, [f"b{i}" for i in range(124)]
    texts = [" ".join(base)] * (n // share - 40)
    for i in range(40):  # two runs of five shingles differ, then one more: plain Jaccard from 0.80 to 0.85
        copy = list(base)
        for at in ([20, 80] if i % 2 else [20, 81, 123, 0, 1]):
            copy[at] = f"e{i}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(n - len(texts))]
    words = neardup._Words()
    sets = [set(neardup.shingles(t, words)[0].tolist()) for t in texts[:n // share]]
    alike = [len(sets[0] & x) >= 0.8 * len(sets[0] | x) for x in sets]
    assert sum(alike) == n // share
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert {got[i] for i in range(n // share)} == {0} and len(set(got.values())) == n - n // share + 1


def test_links_by_tf_idf_equal_all_pairs_with_exact_frequencies(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(64)]
    texts = []
    for i in range(60):  # half of the words from a passage of a fifth of the documents, then a few words differ or many do
        own = [f"o{i}x{j}" for j in range(56)]
        texts.append(" ".join(passage + own))
        for edits in (1, 2, 3, 4):
            copy = list(own)
            for at in rng.sample(range(8, 52), edits):
                copy[at] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(passage + copy))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(1500 - len(texts))]
    words = neardup._Words()
    sets = [dict(zip(*(x.tolist() for x in neardup.shingles(t, words)), strict=True)) for t in texts]
    held = Counter(h for s in sets for h in s)
    share = {h: n / (len(texts) + neardup.PRIOR_DOCS) for h, n in held.items()}

    def classes(weight):
        weighted = [{h: n * weight(h) for h, n in s.items()} for s in sets[:300]]
        links = []
        for i, a in enumerate(weighted):
            for j, b in enumerate(weighted[:i]):
                common = sum(min(w, b.get(h, 0)) for h, w in a.items())
                if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common):
                    links.append((i, j))
        return _components(300, links)

    want = classes(lambda h: min(1, math.log(share[h]) / math.log(neardup.COMMON_SHARE)))
    plain = classes(lambda h: 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert [got[i] for i in range(300)] == want and want != plain


def test_near_duplicates_of_repeated_rows_null_keys_and_nothing(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (3, None), (None, "")], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == 5 and sum(r["kept"] for r in rows) == 3
    assert {r["class_id"] for r in rows if r["doc_id"] == 7} == {7}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sampler = neardup.Sampler(600)
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a, b = dict(zip(h[:300].tolist(), wa, strict=True)), dict(zip(h[100:].tolist(), wb, strict=True))
    low = sum(min(w, b.get(k, 0)) for k, w in a.items())
    jaccard = low / (sum(a.values()) + sum(b.values()) - low)
    both = np.concatenate([h[:300], h[100:]])
    s = sampler.samples(both, np.log(np.concatenate([wa, wb])).astype(np.float32), np.array([0, 300]))
    assert abs((s[0] == s[1]).mean() - jaccard) < 0.07


def _vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + rng.normal(size=(100, 16)) * rng.uniform(0, 0.12, (100, 1))
    x[200:240] = x[0]
    return x.astype(np.float32)


@pytest.mark.parametrize(("per_list", "block"), [(400, 1000), (20, 9)])
def test_vector_links_equal_all_pairs(spark, monkeypatch, per_list, block):
    monkeypatch.setattr(pq_dedup, "PER_LIST", per_list)
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    x = _vectors()
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [float("inf")] + [1.0] * 15]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(300 + i, v, 1) for i, v in enumerate(odd)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    want = _components(300, list(zip(*np.nonzero(linked), strict=True)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int")
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(df, slack=1.0).collect()}
    assert [got[i]["n_links"] for i in range(300)] == linked.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(300)] == want
    assert all(got[300 + i]["n_links"] == 0 and got[300 + i]["kept"] for i in range(len(odd)))
    assert pq_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_rarer_lengths_link_among_themselves(spark):
    x = _vectors()[:60]
    rare = [[3.0, 4.0], [3.0, 4.0], [3.1, 4.0], [-4.0, 3.0], [3.0, 4.0, 0.0], [1.0], [2.0], [-2.0], [3.0, 4.0] + [0.0] * 14]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v) for i, v in enumerate(rare)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.near_duplicates(df).collect()}
    assert [got[100 + i] for i in range(9)] == [(2, 100), (2, 100), (2, 100), (0, 103), (0, 104), (1, 105), (1, 105), (0, 107),
                                                (0, 108)]


@pytest.mark.parametrize("n", [1, 2, 5, 11, 15, 30, 200])
def test_neighbours_of_small_tables_are_complete(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    rare = [(1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (1002, [5.0, 5.0]), (1003, [1.0])] if n > 10 else []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + rare, "vec_id long, embedding array<double>")
    asked = [i for i in (0, n // 2, n - 1)] + [r[0] for r in rare]
    found = curves.neighbours(df, df.where(F.col("vec_id").isin(asked))).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in asked}
    for q in asked:
        if q < n:
            d = ((x - x[q]) ** 2).sum(1)
            assert got[q] == [i for i in np.lexsort((np.arange(n), d)).tolist() if i != q][:10]
    if rare:
        assert [got[q] for q in (1000, 1001, 1002, 1003)] == [[1001, 1002], [1000, 1002], [1001, 1000], []]


@pytest.mark.parametrize("rank", [2, 4])
def test_no_link_across_lists_is_lost_as_registered(spark, monkeypatch, rank):
    monkeypatch.setattr(pq_dedup, "PER_LIST", 20)
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(1200, rank)) @ rng.normal(size=(rank, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(1200)] == linked.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(1200)] == _components(1200, list(zip(*np.nonzero(linked), strict=True)))


def test_neighbours_recall_order_and_scores(spark):
    x = np.random.default_rng(3).normal(size=(1500, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, x[100].tolist()), (1501, None), (1502, [0.0] * 24), (None, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = curves.neighbours(df, df.where("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 1501, 100):
        own = x[100] if q == 1500 else x[q]
        d = np.append(((x - own) ** 2).sum(1), ((x[100] - own) ** 2).sum())
        d[q] = np.inf
        best = np.lexsort((np.arange(1501), d))[:10]
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert np.allclose([r["score"] for r in got], np.sqrt([d[r["vec_id"]] for r in got]))
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        hits += len(set(best.tolist()) & {r["vec_id"] for r in got})
    assert hits / 160 >= 0.9
    few = curves.neighbours(df.where("vec_id < 4"), df.where("vec_id = 0"))
    assert few.count() == 3
    assert curves.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_hilbert_neighbours_on_the_curve_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 3)
    order = np.argsort(keys)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><article><header><h2>Title &amp; more</h2></header><p>One  <b>two</b>
three&nbsp;4 &lt;5<br>six<p>Unclosed <i>para<div class="ad">Buy</div><ul><li>a<li>b</ul><form><input>Name</form>
<section id="comments"><p>Nice post</p></section><p hidden>no</p></article><footer>&copy; F</footer><!-- c --></body></html>"""


def test_page_text(spark):
    pages = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.example/2", "just <b>text</b> 1 < 2 & so"),
             (5, "http://a.example/3", "<p>open <a href='unfinished"), (6, "http://a.example/4", "<!-- never closed <p>x"),
             (7, "http://a.example/5", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert got == {1: "Title & more\nOne two three 4 <5 six\nUnclosed para\na\nb", 2: "", 3: "", 4: "just text 1 < 2 & so",
                   5: "open", 6: "", 7: "deep"}


def test_what_repeats_over_a_site_goes_but_not_articles(spark):
    pages = [(i, f"http://s.example/{i}", f"<body><div class=x><p>Same everywhere</p></div><div class=y><p>Page {i}</p></div></body>")
             for i in range(12)]
    pages += [(50 + i, f"http://t.example/{i}", "<article><p>Equal article</p></article>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert got == {**{i: f"Page {i}" for i in range(12)}, **{50 + i: "Equal article" for i in range(12)}}
    assert site_tree.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("holder", ["article", "main", "main><article"])
def test_what_repeats_without_a_name_goes_inside_articles_too(spark, holder):
    end = "".join(f"</{tag}>" for tag in reversed(holder.split("><")))
    inner = "<div class=x12><p>Follow us for more</p></div><h2>Title {i}</h2><section><p>Body {i}</p></section><ul><li>Terms apply</ul>"
    pages = [(i, f"http://s.example/{i}", f"<body><div>Top {i}</div><{holder}>{inner.format(i=i)}{end}</body>") for i in range(12)]
    # copies of one page do not make its article a part of the site, and few pages are not judged
    pages += [(100 + i, f"http://s.example/{i}", pages[0][2]) for i in range(200)]
    pages += [(500 + i, f"http://u.example/{i}", pages[i][2]) for i in range(7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    want = {i: f"Title {i}\nBody {i}" for i in range(12)} | {100 + i: "Title 0\nBody 0" for i in range(200)}
    assert got == want | {500 + i: f"Follow us for more\nTitle {i}\nBody {i}\nTerms apply" for i in range(7)}


@pytest.mark.parametrize(("page", "text"), [
    ("<body><article class=card><p>Teaser</p></article><div class=content><p>" + "A long story. " * 9 + "</p></div>",
     "Teaser\n" + ("A long story. " * 9).strip()),
    ("<article><p>One</p><div class='side-by-side'><p>Two</p></div><div class='legal analysis'><p>Three</p></div>"
     "<div id=share-price>Four</div><div class='share-buttons'>Tweet</div><div class=related>More</div></article>",
     "One\nTwo\nThree\nFour"),
    ("<main><p>Story</p><article class='post-reply'><p>First!</p></article><article><p>Second part</p></article></main>",
     "Story\nSecond part"),
    ("<div>Site name</div><article><p>A short but real article</p></article>", "A short but real article"),
])
def test_what_is_article_and_what_is_not(spark, page, text):
    df = spark.createDataFrame([(1, "http://a.example/1", page, 7, "x")], "page_id int, url string, html string, _dull int, _HOST string")
    row = site_tree.extract(df).first()
    assert row["text"] == text and row["_dull"] == 7 and row["_HOST"] == "x"
    assert site_tree.extract(df, out="html").first()["html"] == text


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op9_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.9


def test_quality_of_odd_texts_and_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "*** !!!"), (None, "word " * 3000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = quality.score(df, quality.train(df, none)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(df.limit(0), quality.train(df.limit(0), none)).count() == 0


def test_pipeline_stages_do_their_work(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    last = None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), stage(spark, docs, folder).cache()
        assert docs.count() > 0
        if name in ("quality_classifier", "near_dedup"):
            assert docs.count() <= before
        if name == "secret_scan":
            assert docs.where(r"text rlike '[0-9a-f]{24,}'").count() == 0 and docs.count() == before
        last = docs
    assert last.where("not round_trip").count() == 0
    there = lambda: {f.name for f in Path(store.shared_folder(spark).removeprefix("file:")).glob("llm-*")}
    before = there()
    run = corpus_pipeline.run(spark, folder)
    assert [name.split("-")[1] for name in there() - before] == ["source_mix"]  # what the last stage reads, no more
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(r["doc_id"] for r in last.collect())
