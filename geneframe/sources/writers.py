"""Sinks. Texts are made by columns; a small table's comes to the driver, which writes one file, large ones are written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codon import codon_text
from ..operators.pssm import pssm_frequency, pssm_text
from ..operators.regions import region_fasta
from .files import write_named


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small text as a file, in any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def sink_codon_table(table: DataFrame, path: str, **options) -> None:
    """One table's text as one file: a row comes to the driver."""
    put(table.sparkSession, path, "".join(r["value"] for r in codon_text(table, **options).orderBy("table_id", "frame").collect()))


def sink_codon_batch(table: DataFrame, prefix: str, kind: str = "count") -> list[str]:
    """A file for each frame: counts without decimals, frequencies and preferences with four."""
    names = []
    for r in codon_text(table, decimal=0 if kind == "count" else 4).orderBy("frame").collect():  # a row a frame
        names.append(f"{prefix}_rf{r['frame']}.{kind}.txt")
        put(table.sparkSession, names[-1], r["value"])
    return names


def sink_pssm(pssm: DataFrame, meta: DataFrame, path: str, **options) -> None:
    """One matrix as one file."""
    put(pssm.sparkSession, path, "".join(r["value"] for r in pssm_text(pssm, meta, **options).orderBy("pssm_id").collect()))


def sink_splice_models(models: DataFrame, meta: DataFrame, folder: str, pre: int = 5, post: int = 10, **options) -> list[str]:
    """donor.dat and acceptor.dat: the frequencies of the models' counts, which are made once."""
    names, models = [], models.persist()
    for kind, offset in (("donor", pre), ("acceptor", post)):
        names.append(f"{folder}/{kind}.dat")
        sink_pssm(pssm_frequency(models.where(F.col("pssm_id") == kind)), meta, names[-1], offset=offset, **options)
    models.unpersist()
    return names


def sink_region_fasta(regions: DataFrame, path: str, width: int = 100) -> None:
    region_fasta(regions, width).write.mode("overwrite").text(path)


def sink_json(inputs: DataFrame, folder: str) -> None:
    """gene_id, json -> {gene_id}.json for each gene."""
    write_named(inputs.select(F.concat("gene_id", F.lit(".json")).alias("path"), F.lit(0).alias("place"), F.col("json").alias("value")), folder)


def sink_sample_tsv(sample: DataFrame, path: str) -> None:
    """A sample is bounded by its quotas, so one sorted file is right."""
    sample.orderBy("gene_id").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def sink_metrics(plddt: DataFrame, summary: DataFrame, pae: DataFrame, metadata: DataFrame, folder: str) -> None:
    """The metrics as Parquet, a folder for each and in it one for each protein."""
    for name, df in (("plddt", plddt), ("summary", summary), ("pae", pae), ("metadata", metadata)):
        df.write.mode("overwrite").partitionBy("gene_id").parquet(f"{folder}/{name}")


def sink_metrics_tsv(lines: DataFrame, folder: str) -> None:
    """The lines of process_protein as files: {gene_id}/plddt.tsv and so on. Either all files of the call are there or none is new.
    A protein's files are made in one task, so its folder is made once."""
    write_named(lines.select("gene_id", F.concat("gene_id", F.lit("/"), "name").alias("path"), "place", "value"), folder, together="gene_id")
