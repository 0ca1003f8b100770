"""Mixing sources to target weights by hash-threshold histograms.

Source targets come from weights by water-filling: sources in code point order (null last) weigh WEIGHTS, repeated;
together they share `budget` (a share of all words); a target stops at `most` times its source's words, and the excess
is shared again by weight.

Within a source every document is taken floor(target / words) times, and what the target still lacks comes from the
documents with the smallest hashes.  No sort finds that threshold: words are summed by (source, 12 bits of the hash),
a running sum over the at most 4096 sums of a source names the boundary bucket, and only that bucket is summed again by
the next 12 bits, five times in all, down to single hashes.  Thresholds of a larger target contain those of a smaller
one.  A hash's documents are taken if the middle of their words still lies within the target, so a source misses its
target by at most half the words under one hash.

Hashes are the first 60 bits of the id's md5, so reruns agree.  Cases: null text has size 0; documents of size 0 count
as taken 0 words.  Rows of one doc_id share a hash and are taken together.  A null source is a source of its own; a null
doc_id hashes like the empty string.  An empty table gives an empty result.  Extra columns are passed over; where one is
named `copy`, the number of a copy is in `copy_`, and so on.

The plan has a row for each source.  Up to BROADCAST of them are broadcast, so texts aren't dealt out by source; plans
of more sources are joined with each source's rows dealt into parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import counted, cut, salted

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
LEVELS, BITS = 5, 12
#: Rows of a plan that are broadcast at most (about 100 bytes each).
BROADCAST = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def id_hash(id_col: Column) -> Column:
    """60 bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, which is all that is sorted."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight)
    # sources reach their cap in the order of cap / weight
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy())
    level = (all_words * budget - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(onward)
    w = w.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("source_size") * most)
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())
    capped = (F.col("source_size") * most).cast("double")
    return w.select("source", "source_size", F.when(F.col("full") | first_open.isNull(), capped).otherwise(F.least(capped, first_open["level"] * F.col("weight"))).alias("target"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_plan(rows: DataFrame, plan: DataFrame, sources: int, source: Column, spread: Column) -> DataFrame:
    """rows with the columns of their source's row in the plan (s, ...)."""
    keyed = plan.withColumn("__none", F.col("s").isNull()).withColumn("__source", F.coalesce("s", F.lit(""))).drop("s")
    at = rows.withColumns({"__none": source.isNull(), "__source": F.coalesce(source, F.lit(""))})
    if sources <= BROADCAST:
        return at.join(F.broadcast(keyed), ["__none", "__source"]).drop("__none", "__source")
    return salted(at, keyed, ["__none", "__source"], spread).drop("__none", "__source")


def plan_mix(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> tuple[DataFrame, int]:
    """(s, source_size, target, whole, threshold), a row for each source of (source, size, hash), and how many these are."""
    plan = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    # the boundary so far: hashes that begin with `prefix`, `under` words lie before them
    plan, (sources,) = counted(plan.withColumns({"prefix": F.lit(0).cast("long"), "under": F.lit(0).cast("long")}))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        at = with_plan(thin, plan.select(F.col("source").alias("s"), "prefix", "under", "lack"), sources, F.col("source"), F.col("hash"))
        inside = at.where(F.shiftright("hash", shift + BITS) == F.col("prefix")) if level > 1 else at
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("under").alias("under"), F.first("lack").alias("lack"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        # the last bucket that is begun: what lies before it is wholly within the target
        begun = sums.withColumn("before", F.col("under") + run - F.col("words")).where("before <= lack").groupBy(F.col("source").alias("s")).agg(F.max(F.struct("bucket", "before", "words")).alias("b"))
        plan, _ = counted(
            plan.join(begun, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "whole", "lack", F.coalesce("b.bucket", F.shiftleft("prefix", BITS)).alias("prefix"), F.coalesce("b.before", "under").alias("under"), F.coalesce("b.words", F.lit(0)).alias("words"),
            )
        )
    # the last hash itself goes with the target if its middle does
    within = F.col("under") + F.col("words") / 2 <= F.col("lack")
    done, _ = counted(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", (F.col("prefix") + F.when(within, 1).otherwise(0)).alias("threshold")))
    return done, sources


def _copies(hash_: Column, most: int) -> Column:
    return F.least(F.col("whole") + (hash_ < F.col("threshold")).cast("long"), F.lit(most).cast("long"))


def _thin(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each row of docs."""
    thin = _thin(docs, id_col, text_col, source_col)
    plan, sources = plan_mix(thin, weights, budget, most)
    out = with_plan(thin, plan, sources, F.col("source"), F.col("hash")).withColumn("copies", _copies(F.col("hash"), most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its number from 1 on in a new column `copy`."""
    plan, sources = plan_mix(_thin(docs, id_col, text_col, source_col), weights, budget, most)
    plan = plan.select("s", F.struct("whole", "threshold").alias("__plan"))
    name = "copy"
    while name in docs.columns:
        name += "_"
    joined = with_plan(docs, plan, sources, F.col(f"`{source_col}`").cast("string"), id_hash(F.col(f"`{id_col}`")))
    copies = F.least(F.col("__plan.whole") + (id_hash(F.col(f"`{id_col}`")) < F.col("__plan.threshold")).cast("long"), F.lit(most).cast("long"))
    rows = joined.withColumn(name, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.expr("cast(array() as array<long>)"))))
    return rows.drop("__plan")


def op5(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP5 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w
), o AS (SELECT level FROM l WHERE level * weight < 2 * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, weight, CASE WHEN level * weight >= 2 * source_size OR (SELECT count(*) FROM o) = 0 THEN (2 * source_size)::DOUBLE
    ELSE least((2 * source_size)::DOUBLE, (SELECT level FROM o) * weight) END AS target FROM l
), p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), g AS (SELECT source, hash, sum(size)::BIGINT AS words FROM d GROUP BY source, hash
), r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS run FROM g
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  d.size * least(2, p.whole + CASE WHEN r.run - r.words / 2 <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END)::BIGINT AS taken,
  least(2, p.whole + CASE WHEN r.run - r.words / 2 <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.hash = d.hash
"""
