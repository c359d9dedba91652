"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, table, written

#: Hash bits looked at by each level; after all of them only rows with equal hashes share a bucket.
LEVEL_BITS, LEVELS = 12, 5
#: No source is taken more often than this.
MOST = 3


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns, null as empty."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size), a row for each source -> with target and ratio.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; together they get all words. A target stops at MOST times its source and the
    excess is shared by weight among the others. With the sources in order of source_size / weight, those that stop are a prefix, so one
    running sum finds them. One row per source, already summed up, is all that one task gets.
    """
    w = sizes.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(W.partitionBy())).withColumn("weights", F.sum("weight").over(W.partitionBy()))
    w = w.withColumn("rate", (F.col("total") - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level at which the others meet: that of the first source that it does not fill
    fits = F.col("rate") * F.col("weight") <= MOST * F.col("source_size")
    w = w.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "rate"))).over(W.partitionBy())["rate"])
    w = w.withColumn("target", F.round(F.least(F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"), (MOST * F.col("source_size")).cast("double")), 6))
    return w.select("source", "source_size", "target")


def _mixed(docs: DataFrame, source: str, text: str, key: tuple[str, ...]) -> DataFrame:
    """_row (all columns of docs as a struct, so that no name can clash), size, source_size, target and taken of each row."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    own = row_hash(*(F.col(f"`{k}`") for k in key), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = docs.select(row, F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("size"), own.alias("_hash"))
    bucket = lambda level: F.shiftright("_hash", 60 - LEVEL_BITS * (level + 1))
    # A histogram needs three narrow columns: they are written once and read again by each level.
    narrow = written(rows.select("_source", "size", "_hash"))
    goal = targets(narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")))
    cut = goal.select(F.col("source").alias("_source"), "source_size", "target").withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    cut = written(cut.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumn("prefix", F.lit(0).cast("long")))
    for level in range(LEVELS):
        inside = narrow.join(cut.select(F.col("_source").alias("s"), "prefix"), F.col("s").eqNullSafe(F.col("_source")) & (F.col("prefix") == (bucket(level - 1) if level else 0)))
        sums = inside.groupBy("_source", bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        upto = W.partitionBy("_source").orderBy("b")
        sums = sums.withColumn("below", F.sum("n").over(upto) - F.col("n")).withColumnRenamed("_source", "s")
        found = sums.join(cut.drop("n"), F.col("s").eqNullSafe(F.col("_source"))).where("below <= left").groupBy("_source", "source_size", "target", "whole", "left")
        old, cut = cut, written(found.agg(F.max_by(F.struct(F.col("b").alias("prefix"), "below", "n"), "b").alias("x")).select("_source", "source_size", "target", "whole", (F.col("left") - F.col("x.below")).alias("left"), "x.prefix", F.col("x.n").alias("n")))
        discard(old)
    discard(narrow)
    cut = cut.select(*(F.col(c).alias(f"_mix_{c}") for c in cut.columns))
    out = rows.join(cut, F.col("_mix__source").eqNullSafe(F.col("_source")), "left")
    whole, left, n, size, at = F.col("_mix_whole"), F.col("_mix_left"), F.col("_mix_n"), F.col("size"), F.col("_mix_prefix")
    share = F.when(n > 0, F.floor(F.least(left, n) * size / n)).otherwise(0)
    more = F.when(F.col("_hash") < at, size).when(F.col("_hash") == at, share).otherwise(0)
    return out.select("_row", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (whole * size + more).cast("long").alias("taken"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with size, source_size, target and taken added (existing columns of these names give way).

    Each source is taken whole floor(target / size) times. For the rest of its budget, its documents are ordered by a hash of their key
    and text; sums by source and hash bucket give the bucket in which the budget ends, only that bucket is cut finer, and after LEVELS
    levels the threshold is one hash value. Documents below it are taken once more; the rows that share the value divide what is left of
    the budget in proportion to their sizes, so a source's words match its target to within one word for each such row. The thresholds of
    the first, second and third pass are nested: a document is never in a later pass without being in the earlier ones.

    Null text has size 0 and is taken 0 times; null source is a source; equal rows get equal shares; texts of any length are only counted;
    other columns may have any names; an empty table stays empty.
    """
    results = ("size", "source_size", "target", "taken")
    m = _mixed(docs, source, text, key)
    return m.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in results), *results)


def resampled(docs: DataFrame, source: str = "source", text: str = "text", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs as the mix takes them: each as many times as taken / size says, rounded to whole copies. All columns stay as they are, whatever
    they are named; nulls, ties and empty tables as in mixed, so a null or empty text is not taken."""
    m = _mixed(docs, source, text, key)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    m = m.select("_row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias("_copy"))
    return m.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix; see mixed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


_SIZES = r"""
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
r AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM w),
l AS (SELECT arg_min(rate, source_size / weight) AS level FROM r WHERE rate * weight <= 3 * source_size),
t AS (SELECT source, source_size, round(least(coalesce(level, 'inf'::DOUBLE) * weight, (3 * source_size)::DOUBLE), 6) AS target FROM r, l),
u AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole, d.h, d.source,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""

ORACLE_SQL = f"""WITH {_SIZES}
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN upto <= floor(target - whole * source_size) THEN size
  WHEN upto - n <= floor(target - whole * source_size) AND n > 0 THEN floor((floor(target - whole * source_size) - (upto - n)) * size / n) ELSE 0 END)::BIGINT AS taken FROM u"""
