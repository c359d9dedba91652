"""Padded gene regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import region_header, reverse_complement
from .chunks import CHUNK, chunked


def begin_le_zero(features: DataFrame, pad: int) -> DataFrame:
    return features.where(F.col("start") - pad <= 0)


def pieces(features: DataFrame, sequences: DataFrame, pad: int = 100, size: int = CHUNK) -> DataFrame:
    """features with piece: the sequence from start - pad to end + pad, cut at the sequence's ends. (seqid, ord) names a feature.

    One join on (seqid, chunk): a feature meets the chunks that it covers, never a whole sequence, and its parts are put together again.
    A feature of a sequence that isn't there is left out; one beyond its sequence's end has an empty piece.
    """
    a, b = F.greatest(F.col("start") - pad, F.lit(1)) - 1, F.col("end") + pad
    first, last = F.floor(a / size), F.floor((b - 1) / size)
    covered = F.when(last >= first, F.array_union(F.array(F.lit(0).cast("long")), F.sequence(first, last))).otherwise(F.array(F.lit(0).cast("long")))
    f = features.select(*features.columns, a.alias("_a"), b.alias("_b"), covered.alias("_all")).select("*", F.explode_outer("_all").alias("chunk"))
    f = f.withColumn("_one", F.size("_all") == 1).drop("_all")
    j = f.join(chunked(sequences, size).withColumnRenamed("seq_id", "seqid"), ["seqid", "chunk"])
    at, upto = F.greatest(F.col("_a") - F.col("chunk") * size, F.lit(0)), F.least(F.col("_b") - F.col("chunk") * size, F.lit(size))
    j = j.withColumn("piece", F.substring(F.col("part"), (at + 1).cast("int"), F.greatest(upto - at, F.lit(0)).cast("int")))
    # most features lie in one chunk and are ready; both sides read the same shuffles
    g = j.where("not _one").select(F.struct(*features.columns).alias("_f"), "seqid", "ord", "chunk", "piece").groupBy("seqid", "ord")
    g = g.agg(F.any_value("_f").alias("_f"), F.array_sort(F.collect_set(F.struct("chunk", "piece"))).alias("_x"), F.bool_or(F.col("piece").isNull()).alias("_none"))
    whole = F.when(~F.col("_none"), F.array_join(F.transform("_x", lambda x: x["piece"]), ""))
    return j.where("_one").select(*features.columns, "piece").unionByName(g.select(*(F.col(f"_f.`{c}`").alias(c) for c in features.columns), whole.alias("piece")))


def gene_regions(features: DataFrame, sequences: DataFrame, pad: int = 100, size: int = CHUNK) -> DataFrame:
    """Features with region (cut at the sequence's ends, reverse complement on the minus strand) and header; see pieces."""
    header = region_header(F.col("parent"), pad, F.col("start"), F.col("end"), F.col("strand"))
    region = F.when(F.col("strand") == "-", reverse_complement(F.col("piece"))).otherwise(F.col("piece"))
    return pieces(features, sequences, pad, size).select(*features.columns, region.alias("region"), header.alias("header"))


def region_fasta(regions: DataFrame, width: int = 100) -> DataFrame:
    """value: FASTA text of each region, lines of `width`."""
    return regions.select(F.concat(F.col("header"), F.lit("\n"), F.regexp_replace("region", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))
