"""Mix sources to target weights by a random order within each source, cut at the source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.store import written

WORD = "[^\\x20\\x09-\\x0D]+"
ROWS_PER_BUCKET = 100_000
KEY_SPACE = 1 << 60


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, ...) with each source's ``target``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes by weight; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above. That
    end state is a water level: sources in order of cap over weight are full below the level. One row per source
    goes through these windows, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)))
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    filled = weighed.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", level)
    # the level of the first source that the water does not fill holds for all behind it
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)
    target = F.when(first.isNull() | (F.col("cap") / F.col("weight") < first["at"]), F.col("cap")).otherwise(
        F.least(F.col("cap"), first["level"] * F.col("weight")))
    return filled.withColumn("target", target).drop("cap", "level", "weight")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        text: str = "text", source: str = "source", identity: Sequence[str] = ("doc_id",),
        carry: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """One row per row of ``df``: identity and ``carry`` columns, size, source_size, target, taken and copies.

    Every row gets a hash-random key from its identity, source and text. Within a source rows are ordered by key; a
    target of e whole passes and a rest takes every row e times, and once more the rows whose middle lies within the
    rest. ``taken`` is words (size × copies). Prefix sums run in two levels: buckets of equal key width hold about
    ``ROWS_PER_BUCKET`` rows each, their totals give every bucket's start, and only the bucket with the cut is ordered
    by key. Rows that share a key (repeated rows) count as one block there; how many of its rows are taken is settled
    by input partition first, so a block of any size is spread too.

    A null source is a source of its own; a null or empty text has size 0 and is not taken. Equal inputs give equal
    multisets of rows, however they are partitioned. An empty table gives no rows. Identity and carried columns may
    not be named like the result's other columns.
    """
    seeded = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e"))
                                                     for c in (*identity, source, text)])
    key = F.conv(F.substring(F.md5(seeded), 1, 15), 16, 10).cast("long")
    kept = list(dict.fromkeys([*identity, *carry]))
    rows = written(df.select(*[F.col(c).alias(f"_kept_{c}") for c in kept], F.col(source).alias("_source"), words(F.col(text)).alias("size"),
                             key.alias("_key"), F.monotonically_increasing_id().alias("_tie")), "mix")
    sources = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"),
                                                                 F.count("*").alias("_n"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(sources, weights, share, most).withColumn("_passes", passes.cast("int")).withColumn(
        "_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    plan = written(plan.withColumn("_buckets", F.ceil(F.col("_n") / ROWS_PER_BUCKET)), "mix-plan")
    placed = rows.join(plan, _same("_source", "source"), "left").withColumn(
        "_bucket", F.floor(F.col("_key") / F.lit(float(KEY_SPACE)) * F.col("_buckets")))

    by = Window.partitionBy("source")
    buckets = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("w"), F.first("_rest").alias("_rest"))
    ends = buckets.withColumn("end", F.sum("w").over(by.orderBy("_bucket"))).where("end > _rest")
    crossing = written(ends.groupBy("source").agg(F.min(F.struct("_bucket", "end", "w")).alias("x")).select(
        F.col("source").alias("s2"), F.col("x._bucket").alias("b2"), (F.col("x.end") - F.col("x.w")).alias("start")),
        "mix-buckets")

    inside = placed.join(crossing, _same("_source", "s2") & (F.col("_bucket") == F.col("b2")))
    blocks = inside.groupBy("source", "_key").agg(F.sum("size").alias("w"), F.max("size").alias("one"),
                                                  F.first(F.col("_rest") - F.col("start")).alias("left"))
    ends = blocks.withColumn("end", F.sum("w").over(by.orderBy("_key"))).where("end > left")
    cut = ends.groupBy("source").agg(F.min(F.struct("_key", "one", (F.col("left") - F.col("end") + F.col("w")).alias(
        "room"))).alias("x"))
    # the middle of a row decides, so the words taken end at most half a row from the budget
    cut = written(cut.select(F.col("source").alias("s3"), F.col("x._key").alias("_cut"),
                             F.round(F.col("x.room") / F.col("x.one")).alias("_some")), "mix-cut")

    decided = placed.join(cut, _same("_source", "s3"), "left")
    at_cut = F.coalesce(F.col("_key") == F.col("_cut"), F.lit(False))
    more = F.when((F.col("_rest") > 0) & (F.col("_cut").isNull() | (F.col("_key") < F.col("_cut"))), 1).otherwise(0)
    block = decided.where(at_cut).withColumn("_part", F.shiftright("_tie", 33))
    parts = block.groupBy("source", "_part").agg(F.count("*").alias("here"))
    parts = parts.select(F.col("source").alias("s4"), F.col("_part").alias("p4"), (F.sum("here").over(
        by.orderBy("_part")) - F.col("here")).alias("_earlier"))
    number = F.col("_earlier") + F.row_number().over(Window.partitionBy("source", "_part").orderBy("_tie"))
    numbered = block.join(parts, _same("source", "s4") & (F.col("_part") == F.col("p4"))).withColumn(
        "_more", F.when(number <= F.col("_some"), 1).otherwise(0))
    columns = [*[f"_kept_{c}" for c in kept], "size", "source_size", "target", "_passes", "_more"]
    both = decided.where(~at_cut).withColumn("_more", more).select(*columns).union(numbered.select(*columns))
    copies = F.when(F.col("size") > 0, F.col("_passes") + F.col("_more")).otherwise(0)
    return both.select(*[F.col(f"_kept_{c}").alias(c) for c in kept], "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                       copies.cast("int").alias("copies"))
