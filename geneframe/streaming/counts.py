"""An extension: codon counts over a stream of sequences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import codon_split


def streaming_codon_count(sequences: DataFrame, frames=(0, 1, 2)) -> DataFrame:
    """Running counts for output mode 'complete' or 'update'; the state has at most 64 rows a frame."""
    e = sequences.select("seq", F.explode(F.array(*map(F.lit, frames))).alias("frame"))
    return e.select("frame", F.explode(codon_split(F.col("seq"), F.col("frame"))).alias("codon")).where(F.col("codon").rlike("^[ACGT]{3}$")).groupBy("frame", "codon").agg(F.count("*").alias("n"))
