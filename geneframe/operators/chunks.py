"""Sequences in chunks, so that no plan joins or scans whole chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a chunk: divisible by three, so that codons of frame 0 never cross chunks.
CHUNK = 3 << 14


def chunked(sequences: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """seq_id, chunk, part, length: letters chunk * size to chunk * size + size + overlap of each sequence, and its whole length.

    overlap is at most size. A sequence is cut in one pass; one that fits a chunk isn't cut. An empty sequence has one empty chunk, a null
    one a null chunk. Rows keep their partition: there is no shuffle.
    """
    seq = F.col("seq")
    cut = F.when(seq.isNull() | (F.length(seq) <= size), F.array(seq)).otherwise(F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    s = sequences.select("seq_id", F.length(seq).cast("long").alias("length"), cut.alias("cut"))
    if overlap:
        more = F.transform("cut", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("cut", i + 1), F.lit(overlap)), F.lit(""))))
        s = s.withColumn("cut", F.when(F.size("cut") > 1, more).otherwise(F.col("cut")))
    # no array is empty; the outer form keeps the optimiser from adding a filter on its size, which would make the sequence again
    return s.select("seq_id", "length", F.posexplode_outer("cut").alias("chunk", "part")).select("seq_id", F.col("chunk").cast("long").alias("chunk"), "part", "length")
