"""One registered query for each operator of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.vectors import finite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_minhash_near_dedup(spark, folder):
    from casebook.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query()
def op2_bpe(spark, folder):
    from casebook.llm import bpe

    coded = bpe.encode_and_decode(table(spark, folder, "documents", "doc_id", "text"), vocabulary())
    return coded.select("doc_id", *bpe.digests(coded))


@query("""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
        AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.x, b.x) >= 0.95),
    reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
        vec_id <= coalesce(low, vec_id) AS kept
    FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
    LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)""")
def op3_pq_near_dedup(spark, folder):
    from casebook.llm.pq_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query()
def op4_hilbert_neighbours(spark, folder):
    from casebook.llm.curves import neighbours

    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return neighbours(rows, rows.where("vec_id % 100 = 0"))


_ENTROPY_RUN = "[A-Za-z0-9+/_=-]{20,}"


def _between(kind: str, pattern: str) -> str:
    """Matches of a pattern with their places, from the pieces between them."""
    return f"""SELECT r, '{kind}' AS kind, found, s::INTEGER AS s, (s + length(found))::INTEGER AS e FROM (
        SELECT r, unnest(range(1, len(m) + 1)) AS i, m[i] AS found,
            (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)) AS s
        FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d)
        WHERE len(m) > 0)"""


def _secrets_sql() -> str:
    from casebook.llm import secret_scan as secrets

    assign = secrets.ASSIGN.replace("'", "''").replace("(?i:", "(?i:")
    rule = secrets.DEFAULT
    bits = " ".join(f"WHEN regexp_matches(found, '{p}') THEN {b}" for _, p, b in rule.classes)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS (
        SELECT * FROM ({_between('assign', assign)}) WHERE length(regexp_extract(found, '{assign}', 2)) >= 6
        UNION ALL {_between('access', secrets.ACCESS)} UNION ALL {_between('hex', secrets.HEX)}
        UNION ALL SELECT r, kind, found, s, e FROM (
            SELECT *, CASE {bits} END AS bits, string_split(found, '') AS c FROM ({_between('entropy', _ENTROPY_RUN)}))
        WHERE NOT regexp_matches(found, '{rule.allowed}') AND round(list_max(list_transform(
            range(1, length(found) - 18), lambda i: list_entropy(c[i:i + 19]))), 9) >= bits),
    keyed AS (SELECT r, kind, s, list_position(['assign', 'access', 'hex', 'entropy'], kind) AS place,
        kind || ':' || s || ':' || e AS word FROM spans),
    per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, string_agg(word, ',' ORDER BY s, place) FILTER (kind <> 'entropy') AS base,
        string_agg(word, ',' ORDER BY s, place) AS spans FROM keyed GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""


@query(_secrets_sql())
def op5_secret_scan(spark, folder):
    from casebook.llm import secret_scan as secrets

    found = secrets.scan(table(spark, folder, "documents", "doc_id", "text"))
    spans = F.col("secrets")
    return found.select(
        "doc_id", *[secrets.count(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listing(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.listing(spans).alias("spans"))


def _licenses_sql() -> str:
    from casebook.llm import licenses

    def normal(t: str) -> str:
        without = (f"regexp_replace({t}, '(?im)^[^\\p{{L}}\\n]*(?:copyright|\\(c\\)|©)[^\\n]*(?:\\n|$)', chr(10), 'g')")
        plain = f"trim(regexp_replace(lower({without}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        pairs = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items()) + "}"
        return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(({pairs})[w], w)), ' ')"

    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.KNOWN)
    return f"""WITH known AS (SELECT sha256({normal('known')}) AS digest, min(license) AS license, bool_or(known NOT LIKE '%'
            || chr(10) || '%') AS line FROM (VALUES {quoted}) v(license, known) GROUP BY 1),
    d AS (SELECT row_number() OVER () AS r, * FROM documents),
    whole AS (SELECT r, license FROM (SELECT r, sha256({normal('text')}) AS digest FROM d) JOIN known USING (digest)),
    lines AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (
        SELECT r, sha256({normal('line')}) AS digest FROM (SELECT r, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM d)
        WHERE regexp_matches(line, '(?i)licen[sc]e|released under|permission')) JOIN known USING (digest) WHERE line GROUP BY r)
    SELECT doc_id, license, coalesce(notices, '') AS notices FROM d LEFT JOIN whole USING (r) LEFT JOIN lines USING (r)"""


@query(_licenses_sql())
def op6_license_scan(spark, folder):
    from casebook.llm.licenses import scan

    return scan(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", "license", F.array_join("notices", ",").alias("notices"))


_KEY = "('0x' || substr(md5(concat_ws(chr(31), '0', coalesce(doc_id::VARCHAR, chr(30)), coalesce(source, chr(30)), " \
       "coalesce(text, chr(30)))), 1, 15))::BIGINT"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_KEY} AS k,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
        sum(source_size) OVER () * 1.5::DOUBLE AS total
        FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
    fill(round, source, source_size, w, total, target, full_) AS (
        SELECT 0, source, source_size, w, total, 0.0::DOUBLE, false FROM s
        UNION ALL
        SELECT round + 1, source, source_size, w, total, least(t, 2.0 * source_size), full_ OR t >= 2.0 * source_size FROM (
            SELECT *, CASE WHEN full_ THEN 2.0 * source_size ELSE w * (total
                - coalesce(sum(2.0 * source_size) FILTER (full_) OVER (), 0)) / sum(w) FILTER (NOT full_) OVER () END AS t
            FROM fill) WHERE round < 30),
    plan AS (SELECT source, source_size, target,
        CASE WHEN source_size > 0 THEN floor(round(target / source_size, 12)) ELSE 0 END AS passes FROM fill WHERE round = 30),
    o AS (SELECT d.*, source_size, target, passes, target - passes * source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id) - size AS start
        FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source)
    SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN rest > 0 AND start + size <= rest
        OR rest > start AND round((rest - start) / size) >= 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM o""")
def op7_source_mix(spark, folder):
    from casebook.llm.mixing import mix

    return mix(table(spark, folder, "documents", "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query()
def op8_site_tree_extract(spark, folder):
    from casebook.llm.site_tree import extract

    pages = extract(table(spark, folder, "pages", "page_id", "url", "html")).drop("html")
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op9_quality(spark, folder):
    from casebook.llm import quality

    docs = table(spark, folder, "documents", "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labelled = table(spark, folder, "labels", "doc_id", "quality").where(~held_out).select(
        "doc_id", F.col("quality").alias("label"))
    scores = quality.score(docs, quality.train(docs, labelled))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_SPEAKER = "CASE WHEN trim(role, ' ') IS NULL OR trim(role, ' ') = '' THEN 'unknown' ELSE trim(role, ' ') END"


@query(f"""WITH t AS (SELECT conv_id, coalesce(floor(turn / 64), -1)::BIGINT AS part, turn, {_SPEAKER} AS speaker,
        coalesce(text, '') AS said FROM conversations),
    p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
    x AS (SELECT t.*, p.perspective, '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system'
        THEN 'system' ELSE 'user name=' || regexp_replace(speaker, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') END || '|>' || chr(10) AS head,
        said || '<|end|>' || chr(10) AS body
        FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part
        ORDER BY turn NULLS LAST, speaker, said ROWS UNBOUNDED PRECEDING) AS stop FROM x)
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY stop) AS rendered,
        coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop)
            FILTER (speaker = perspective), '') AS masks
    FROM y GROUP BY conv_id, perspective, part""")
def op10_chat_rotation(spark, folder):
    from casebook.llm.chat import perspectives

    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return perspectives(turns).withColumn("masks", masks)


@query()
def op11_whitening(spark, folder):
    from casebook.llm import whitening

    # beyond a long's range an entry is cut, so that no row is lost
    fixed = F.transform("embedding", lambda c: F.floor(
        F.greatest(F.least(64 * c.cast("double"), F.lit(4e18)), F.lit(-4e18))) + F.lit(1_000_000).cast("long"))
    rows = table(spark, folder, "embeddings", "vec_id", "embedding").where(finite("embedding"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("float"), F.lit(longest) - F.size("embedding"))  # what a shorter vector lacks
    rows = rows.withColumn("embedding", F.concat("embedding", zeros)).select("vec_id", fixed.alias("x"))
    model = whitening.fit(rows, "x")
    columns = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
               "identity_error double")
    if model is None:
        return spark.createDataFrame([], columns)
    k = min(32, model.dims)
    # (n * x - S) of each entry, as n * (x - base) - (S - n * base); null where it does not fit a long
    base = F.array(*[F.lit(int(b)).cast("long") for b in model.base])
    left = F.array(*[F.lit(s - model.n * int(b)).cast("long") for s, b in zip(model.sums, model.base, strict=True)])
    n = F.lit(model.n).cast("long")

    def part(x, b, s):
        return F.try_subtract(F.try_multiply(n, F.try_subtract(x, b)), s)

    terms = F.transform(F.arrays_zip("x", base.alias("b"), left.alias("s")),
                        lambda t: part(t["x"], t["b"], t["s"]))
    deviation = F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: F.try_add(a, F.try_multiply(t, t)))
    explained = F.array(*[F.lit(float(e)) for e in model.explained[:k]])
    error = whitening.identity_error(rows, model, "x")
    return whitening.whiten(rows.withColumn("deviation", deviation), model, "x").select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), n.alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score,
        s.score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, p.other
            ORDER BY s.score DESC, s.other))::INTEGER AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13_hard_negatives(spark, folder):
    from casebook.llm.hard_negatives import mine

    fixed = F.transform("embedding", lambda c: F.floor(256 * c.cast("double")))  # beyond a long's range it is cut
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label").where(finite("embedding")).select(
        "vec_id", label.alias("label"), fixed.alias("x"))
    return mine(rows, rows.where("vec_id % 100 = 0"), "x")


@query()
def op12_class_lm(spark, folder):
    from casebook.llm import class_lm

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = class_lm.train(docs.where(~held_out))
    return class_lm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        F.col("lm.base").alias("base_score"), F.col("lm.score").alias("score"), "lm.perplexity")
