"""Proteins: exon counts, stratified samples, predictor inputs, confidence metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES, description, fixed, has_introns, normalize_parent
from ..session import scratch

QUOTA, FORCED = 20, 3


def exon_count_by_gene(cds: DataFrame) -> DataFrame:
    return cds.groupBy(normalize_parent(F.col("parent")).alias("gene_id")).agg(F.count("*").alias("n_exons"))


def join_exon_counts(proteins: DataFrame, counts: DataFrame) -> DataFrame:
    return proteins.drop("n_exons").join(counts, "gene_id", "left").withColumn("n_exons", F.coalesce("n_exons", F.lit(1)))


def sample_key(gene_id: Column, seed: int) -> Column:
    return F.md5(F.concat(gene_id.cast("string"), F.lit(f"-{seed}")))


def stratified_sample(proteins: DataFrame, seed: int = 42, quota: int = QUOTA, forced: int = FORCED) -> DataFrame:
    """proteins (gene_id, category, length_bin, n_exons) -> the sampled rows with is_forced; gene_id is unique.

    The first `forced` genes with introns of a category, in an order by hash, are taken; then each bin is filled up to the quota. A bin needs
    no others than its first `quota` genes and the forced ones, so each map task sends at most that many rows of a stratum: both ranks are
    compared with a constant, and Spark keeps the first rows before it shuffles.
    """
    order = [F.col("key"), F.col("gene_id")]
    first = lambda d, n, *by: d.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")
    p = proteins.withColumn("key", sample_key(F.col("gene_id"), seed))
    must = first(p.where("n_exons > 1"), forced, "category").withColumn("is_forced", F.lit(True))
    may = first(p, quota, "category", "length_bin").withColumn("is_forced", F.lit(False))
    by = W.partitionBy("category", "length_bin", "gene_id").orderBy(F.col("is_forced").desc())
    both = must.unionByName(may).withColumn("r", F.row_number().over(by)).where("r = 1")
    both = both.withColumn("r", F.row_number().over(W.partitionBy("category", "length_bin").orderBy(F.col("is_forced").desc(), *order)))
    return both.where((F.col("r") <= quota) | F.col("is_forced")).drop("r", "key")


def predictor_input(proteins: DataFrame, seeds=(1,), dialect: str = "alphafold3", version: int = 4) -> DataFrame:
    """gene_id, json: one input document for each protein."""
    protein = F.struct(F.lit("A").alias("id"), "sequence", description(F.col("category"), F.col("n_exons"), F.col("length_aa"), F.col("chromosome")).alias("description"))
    doc = F.struct(F.col("gene_id").alias("name"), F.array(*map(F.lit, seeds)).alias("modelSeeds"), F.array(F.struct(protein.alias("protein"))).alias("sequences"), F.lit(dialect).alias("dialect"), F.lit(version).alias("version"))
    return proteins.select("gene_id", F.to_json(doc).alias("json"))


def predictor_text(proteins: DataFrame, seeds=(1,), dialect: str = "alphafold3", version: int = 4) -> DataFrame:
    """gene_id, json: the same documents, indented by two, a member a line, without a line's end at the end."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    text = description(F.col("category"), F.col("n_exons"), F.col("length_aa"), F.col("chromosome"))
    numbers = ",\n    ".join(map(str, seeds))
    return proteins.select("gene_id", F.concat(
        F.lit('{\n  "name": '), quoted(F.col("gene_id")), F.lit(f',\n  "modelSeeds": [\n    {numbers}\n  ],\n  "sequences": [\n    {{\n      "protein": {{\n        "id": "A",\n        "sequence": '),
        quoted(F.col("sequence")), F.lit(',\n        "description": '), quoted(text), F.lit(f'\n      }}\n    }}\n  ],\n  "dialect": "{dialect}",\n  "version": {version}\n}}'),
    ).alias("json"))


def sample_metadata(proteins: DataFrame) -> DataFrame:
    return proteins.select("gene_id", "category", "length_aa", "n_exons", has_introns(F.col("n_exons")).alias("has_introns"), "length_bin", "chromosome", "gene_name")


def plddt_per_residue(atoms: DataFrame) -> DataFrame:
    """The first atom's B factor of each residue. With a chain column, chains are kept apart."""
    keys = [c for c in ("gene_id", "chain") if c in atoms.columns] + ["auth_seq_id"]
    return atoms.groupBy(*keys).agg(F.min_by("b_iso", "atom_ord").alias("plddt")).withColumnRenamed("auth_seq_id", "residue_number")


def plddt_stats(plddt: DataFrame, threshold: float = 70.0) -> DataFrame:
    """An extension: mean, median and share at or over a threshold of each protein."""
    return plddt.groupBy("gene_id").agg(F.avg("plddt").alias("mean"), F.percentile("plddt", F.lit(0.5)).alias("median"), F.avg((F.col("plddt") >= threshold).cast("double")).alias("share"))


def segment_means(plddt: DataFrame, size: int) -> DataFrame:
    """An extension: means over segments of `size` residues."""
    return plddt.groupBy("gene_id", F.floor((F.col("residue_number") - 1) / size).cast("int").alias("segment")).agg(F.avg("plddt").alias("mean"))


def join_metrics_meta(predictions: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions with metadata, and those without."""
    return predictions.join(metadata, "gene_id"), predictions.join(metadata, "gene_id", "left_anti")


def known_category(proteins: DataFrame) -> DataFrame:
    """Proteins of the categories that are sampled."""
    return proteins.where(F.col("category").isin(*CATEGORIES))


def _placed(batches):
    """Sorted rows -> their number in the task's run of their stratum, and the task."""
    from pyspark import TaskContext

    part, last, k = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for stratum in zip(batch.column("category").to_pylist(), batch.column("length_bin").to_pylist(), strict=True):
            k = k + 1 if stratum == last else 1
            last = stratum
            places.append(k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array([part] * len(places), pa.int32())], names=[*batch.schema.names, "place", "part"])


def strata(proteins: DataFrame) -> DataFrame:
    """category, length_bin, place, gene_id: the identifiers of each category and bin in order, as rows, so no stratum is one array.

    Ranges of (category, length_bin, gene_id) are sorted and numbered by task, so a stratum may be many tasks; the tasks' numbers of rows, a
    row for each task and stratum in it, are then added up. The sorted rows are written first, when this is called, as their ranges must
    not change between the two.
    """
    by = ["category", "length_bin", "gene_id"]
    rows = proteins.select(*by)
    path = scratch(proteins.sparkSession)
    rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_placed, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", place long, part int").write.parquet(path)
    rows = proteins.sparkSession.read.parquet(path).withColumn("key", F.struct("category", "length_bin"))
    sizes = rows.groupBy("key", "part").agg(F.max("place").alias("n"))
    sizes = sizes.select("key", "part", (F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(sizes, ["key", "part"]).select("category", "length_bin", (F.col("place") + F.col("before")).alias("place"), "gene_id")


def not_forced(proteins: DataFrame, sample: DataFrame) -> DataFrame:
    """Proteins that the sample doesn't hold as forced ones."""
    return proteins.join(sample.where("is_forced").select("gene_id"), "gene_id", "left_anti")


def sorted_ids(df: DataFrame) -> DataFrame:
    """The identifiers in lexical order, one of each."""
    return df.select("gene_id").distinct().orderBy("gene_id")


def process_protein(plddt: DataFrame, summary: DataFrame, pae: DataFrame, metadata: DataFrame, unreadable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gene_id, name, place, value): the lines of each metric file of each protein, in the order of place; and (gene_id, error): proteins
    that have no model or no metadata, or a file that can't be read.

    plddt: gene_id, residue_number, plddt and possibly chain, which is a column of the files of proteins with several. summary: gene_id, ptm,
    fraction_disordered; pae: gene_id, row_idx, pae: a protein without them lacks those files. A protein with an error has no file at all,
    as nothing of it would be complete; the others go on. A line is a row, so no file is one value.
    """
    found = plddt.select("gene_id").distinct()
    error = lambda d, text: d.select("gene_id", F.lit(text).alias("error"))
    bad = error(found.join(metadata.select("gene_id"), "gene_id", "left_anti"), "no metadata")
    missing = metadata.select("gene_id").distinct().join(found, "gene_id", "left_anti")
    if unreadable is not None:
        missing = missing.join(unreadable.select("gene_id"), "gene_id", "left_anti")
        bad = bad.unionByName(unreadable.select("gene_id", "error"))
    bad = bad.unionByName(error(missing, "no model"))
    place = lambda head, chain, k: F.struct(F.lit(head).alias("part"), chain.alias("chain"), k.cast("long").alias("k")).alias("place")
    line = lambda d, name, at, text: d.select("gene_id", F.lit(name).alias("name"), at, F.concat(text, F.lit("\n")).alias("value"))
    one, none = F.lit(""), F.lit(0)
    chain = F.col("chain") if "chain" in plddt.columns else one
    chains = plddt.select("gene_id", chain.alias("c")).groupBy("gene_id").agg((F.min("c") < F.max("c")).alias("several"))
    p = plddt.join(chains, "gene_id")
    if "chain" in plddt.columns:
        first = F.when(F.col("several"), F.concat(F.coalesce("chain", F.lit("")), F.lit("\t"))).otherwise("")
    else:
        first = one
    out = line(chains, "plddt.tsv", place(0, one, none), F.concat(F.when(F.col("several"), "chain\t").otherwise(""), F.lit("residue_number\tplddt")))
    out = out.unionByName(line(p, "plddt.tsv", place(1, F.coalesce(chain, one), F.col("residue_number")), F.concat(first, F.col("residue_number"), F.lit("\t"), fixed(F.col("plddt"), 2))))
    for c in ("ptm", "fraction_disordered"):
        out = out.unionByName(line(summary, f"{c}.tsv", place(0, one, none), F.concat(F.lit(f"{c}\n"), F.coalesce(F.col(c).cast("string"), F.lit("NA")))))
    out = out.unionByName(line(pae, "pae.tsv", place(1, one, F.col("row_idx")), F.array_join(F.transform("pae", lambda v: fixed(v, 2)), "\t")))
    columns = metadata.columns
    out = out.unionByName(line(metadata, "metadata.tsv", place(0, one, none), F.concat(F.lit("\t".join(columns) + "\n"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))))
    good = found.join(metadata.select("gene_id").distinct(), "gene_id", "left_semi").join(bad.select("gene_id"), "gene_id", "left_anti")
    return out.join(good, "gene_id", "left_semi"), bad
