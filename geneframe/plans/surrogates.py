"""The operators' inputs made from the driver's tables, in Spark and as common SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LETTERS, CODES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_LINE = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, CODES)
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), seq.alias("seq"))


#: Features of a task.
ROWS = 500_000


def parts(spark: SparkSession, d: str) -> int:
    """Partitions of the features: the session's number, or more for a large table, so that a task's rows stay bounded. The count is in the
    files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // ROWS))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Exons from order lines: a transcript is an order, its sequence one of the documents."""
    n = table(spark, d, "documents").agg(F.count("*")).scalar()
    x = table(spark, d, "lineitem").withColumn("seqid", F.col("l_orderkey") % n)
    x = x.select("seqid", "l_orderkey", *_LINE).repartition(parts(spark, d), "seqid")
    size = F.col("l_quantity").cast("long")
    # an order is in one sequence: both windows share the sequence's partition and sort
    order = W.partitionBy("seqid").orderBy("l_orderkey", *_LINE)
    x = x.select("seqid", "l_orderkey", *_LINE, size.alias("size"), F.row_number().over(order).cast("long").alias("ord"))
    w = W.partitionBy("seqid", "l_orderkey").orderBy(*_LINE)
    x = x.withColumn("start", 30 + F.coalesce(F.sum(F.col("size") + 40).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return x.select("ord", "seqid", F.lit("exon").alias("type"), "start", (F.col("start") + F.col("size") - 1).alias("end"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("parent"))


def proteins(spark: SparkSession, d: str) -> DataFrame:
    """A protein for each document: its whole text as the sequence."""
    t = table(spark, d, "documents").withColumn("sequence", F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), LETTERS, CODES))
    return t.select(F.concat(F.lit("G"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("gene_id"), F.coalesce("source", F.lit("")).alias("gene_name"), F.coalesce("lang", F.lit("none")).alias("category"), F.coalesce("source", F.lit("")).alias("chromosome"), "sequence", F.length("sequence").alias("length_aa"), (1 + F.col("n_chars") % 3).cast("int").alias("n_exons"))


def residues(spark: SparkSession, d: str) -> DataFrame:
    """Atoms: three of each residue, the first with the vector's value as B factor."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("gene_id"), F.posexplode("embedding").alias("p", "v"))
    return e.select("gene_id", F.explode(F.array(*(F.struct((F.col("p") * 3 + k).cast("long").alias("atom_ord"), (F.col("p") + 1).cast("int").alias("auth_seq_id"), (F.col("v").cast("double") + k).alias("b_iso")) for k in range(3)))).alias("a")).select("gene_id", "a.*")


S1 = f"s1 AS (SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{CODES}') AS seq FROM documents)"
S2 = f"""s2a AS (SELECT l_orderkey % (SELECT count(*) FROM documents) AS seqid, l_orderkey, {', '.join(_LINE)}, l_quantity::BIGINT AS size,
   30 + coalesce(sum(l_quantity::BIGINT + 40) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem),
s2 AS (SELECT row_number() OVER (PARTITION BY seqid ORDER BY l_orderkey, {', '.join(_LINE)}) AS ord, seqid, 'exon' AS type, start, start + size - 1 AS "end", CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'T' || l_orderkey AS parent FROM s2a)"""
S4 = f"""s4 AS (SELECT *, length(sequence)::INTEGER AS length_aa FROM (SELECT 'G' || lpad(doc_id::VARCHAR, 9, '0') AS gene_id, coalesce(source, '') AS gene_name, coalesce(lang, 'none') AS category, coalesce(source, '') AS chromosome,
   translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{CODES}') AS sequence, (1 + n_chars % 3)::INTEGER AS n_exons FROM documents)),
s4b AS (SELECT *, CASE WHEN length_aa BETWEEN 50 AND 100 THEN '50-100' WHEN length_aa BETWEEN 101 AND 200 THEN '101-200' WHEN length_aa BETWEEN 201 AND 300 THEN '201-300' WHEN length_aa BETWEEN 301 AND 500 THEN '301-500' WHEN length_aa BETWEEN 501 AND 800 THEN '501-800' ELSE '>800' END AS length_bin FROM s4)"""
