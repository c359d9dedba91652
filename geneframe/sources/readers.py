"""Readers. Each has a function over text rows, so a table can take the file's place, and one over a path."""

from __future__ import annotations

import io
import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import category_of, chromosome_of, extract_id
from .files import listed, opened, reachable, tasks

GFF_SCHEMA = "seqid string, source string, type string, start long, `end` long, score string, strand string, phase string, attributes string"
METADATA_SCHEMA = "gene_id string, category string, length_aa int, n_exons int, has_introns string, length_bin string, chromosome string, gene_name string"


def file_order() -> Column:
    """A row's place: file, split of the file, row of the split. Rows of a split stay together and in order, whatever order Spark reads the
    splits in, so this is the order of the files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def fasta_records(text: DataFrame) -> DataFrame:
    """value: one record, with or without '>' -> seq_id, doc, seq; with a column at, its place, that as well."""
    v = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(v, r"^([^\n]*)", 1)
    return text.where(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("doc"), F.regexp_replace(F.regexp_replace(v, r"^[^\n]*", ""), r"\s", "").alias("seq"), *(c for c in ("at",) if c in text.columns))


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_records(spark.read.text(path, lineSep="\n>")).select("seq_id", "doc", "seq")


def protein_records(fasta: DataFrame) -> DataFrame:
    """seq_id, doc, seq -> gene_id, gene_name, category, chromosome, sequence, length_aa. A trailing * goes.

    Of equal ids the last stays, by the column at; without it the one of the largest sequence, as rows of a table have no order."""
    name = F.regexp_extract("doc", r"^(\S+)", 1)
    p = fasta.select(
        F.col("seq_id").alias("gene_id"), F.when((name == F.col("seq_id")) | F.contains(name, F.lit(":")), "").otherwise(name).alias("gene_name"), category_of(F.col("doc")).alias("category"), chromosome_of(F.col("doc")).alias("chromosome"), F.regexp_replace("seq", r"\*+$", "").alias("sequence"), *(c for c in ("at",) if c in fasta.columns)
    )
    fields = F.struct("sequence", "gene_name", "category", "chromosome")
    return p.groupBy("gene_id").agg((F.max_by(fields, "at") if "at" in fasta.columns else F.max(fields)).alias("x")).select("gene_id", "x.gene_name", "x.category", "x.chromosome", "x.sequence", F.length("x.sequence").alias("length_aa"))


def scan_protein_fasta(spark: SparkSession, path: str) -> DataFrame:
    return protein_records(fasta_records(spark.read.text(path, lineSep="\n>").select("value", file_order().alias("at"))))


def attributes(c: Column) -> Column:
    return F.map_filter(F.str_to_map(c, F.lit(";"), F.lit("=")), lambda k, v: k != "")


def gff_features(lines: DataFrame, types: list[str] | None = None) -> DataFrame:
    """value: a line, ord: its place -> features with parent; comments and short lines are left out."""
    f = F.split("value", "\t")
    d = lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9)).select("ord", *(F.get(f, i).alias(n) for i, n in enumerate(("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attr"))))
    d = d.where(F.col("type").isin(types)) if types else d
    return d.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long")).withColumn("attributes", attributes(F.col("attr"))).withColumn("parent", F.try_element_at("attributes", F.lit("Parent"))).drop("attr")


def scan_gff(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """ord is the line's place (see file_order)."""
    lines = spark.read.text(path).select("value", file_order().alias("ord"))
    return gff_features(lines, types)


def scan_gff_cds(spark: SparkSession, path: str) -> DataFrame:
    return scan_gff(spark, path, ["CDS"])


def codon_table_fields(text: DataFrame) -> DataFrame:
    """table_id, value (text of a table) -> table_id, codon, value."""
    pair = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"([ACGT]{3}):\s*([0-9.eE+-]+)"), F.lit(1)).alias("c"), F.regexp_extract_all("value", F.lit(r"([ACGT]{3}):\s*([0-9.eE+-]+)"), F.lit(2)).alias("v"))
    return text.select("table_id", F.explode(pair).alias("x")).select("table_id", F.col("x.c").alias("codon"), F.col("x.v").cast("double").alias("value"))


def scan_codon_table(spark: SparkSession, path: str) -> DataFrame:
    return codon_table_fields(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("table_id"), "value"))


def pssm_entries(text: DataFrame) -> DataFrame:
    """pssm_id, value (text of a matrix) -> pssm_id, base, pos, value, offset (columns before the divider)."""
    line = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*([A-Z])\s+([-+0-9.eEnaif|\s]+?)\s*$"), F.lit(0))).alias("line")
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    d = text.select("pssm_id", line).select("pssm_id", F.left(trimmed, F.lit(1)).alias("base"), F.split(F.regexp_replace(trimmed, r"^[A-Z]\s+", ""), r"\s+").alias("f"))
    d = d.withColumn("offset", F.when(F.array_contains("f", "|"), F.array_position("f", "|").cast("int") - 1).otherwise(0))
    return d.select("pssm_id", "base", "offset", F.posexplode(F.array_remove("f", "|")).alias("pos", "v")).select("pssm_id", "base", "pos", F.col("v").cast("double").alias("value"), "offset")


def pssm_meta(text: DataFrame) -> DataFrame:
    """pssm_id, value -> title, uid, creation, n from the tagged lines, and the lines of the comment block; other tags are ignored."""
    tag = lambda k: F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*)$", 1).alias(k)
    block = F.regexp_extract("value", r"(?ms)^comment[^\n]*\n(.*?)^pssm\b", 1)
    comments = F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: x != "")
    return text.select("pssm_id", *(tag(k) for k in ("title", "uid", "creation", "n")), F.transform(comments, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")).alias("comments"))


def scan_pssm(spark: SparkSession, path: str) -> DataFrame:
    return pssm_entries(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("pssm_id"), "value"))


def transcript_text(text: DataFrame) -> DataFrame:
    """seq_id, value (a file's text) -> seq_id, seq."""
    return text.select("seq_id", F.regexp_replace("value", r"\s", "").alias("seq"))


def scan_transcript_txt(spark: SparkSession, path: str) -> DataFrame:
    return transcript_text(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("seq_id"), "value"))


_WORD = re.compile(r"""'((?:[^']|'(?=\S))*)'(?!\S)|"((?:[^"]|"(?=\S))*)"(?!\S)|(\#.*)|(\S+)""")


def _tokens(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """A file's tokens and whether they are bare words, line by line; a text between lines that begin with ; is one token."""
    block = None
    for line in lines:
        line = line.rstrip("\r\n")
        if block is not None:
            if not line.startswith(";"):
                block.append(line)
                continue
            yield "\n".join(block), False
            block, line = None, line[1:]
        elif line.startswith(";"):
            block = [line[1:]]
            continue
        if "'" not in line and '"' not in line and "#" not in line:
            for word in line.split():
                yield word, True
            continue
        for m in _WORD.finditer(line):
            if m[3] is None:
                yield (m[4], True) if m[4] is not None else (m[1] if m[1] is not None else m[2], False)
    if block is not None:
        raise ValueError("the file ends inside a text")


def mmcif_atoms(lines: Iterable[str]) -> Iterator[tuple[int, str, int, float]]:
    """(order, chain, residue, B factor) of each atom in a model's lines, one by one: a row of the table is all that is held.

    A row that is cut off, a number that is none, or a model without atoms is a ValueError."""
    names, row, places, state, n = [], [], None, "", 0
    for token, bare in _tokens(lines):
        low = token.lower() if bare else ""
        if low == "loop_" or low.startswith("data_") or bare and token.startswith("_") and state != "names":
            if places and row:
                raise ValueError("a row of atoms is cut off")
            names, row, places, state = [], [], None, "names" if low == "loop_" else ""
        elif bare and token.startswith("_"):
            names.append(token)
        elif names:
            if state == "names":
                state = "values"
                if "_atom_site.auth_seq_id" in names and "_atom_site.B_iso_or_equiv" in names:
                    places = [names.index(c) if c in names else None for c in ("_atom_site.auth_asym_id", "_atom_site.auth_seq_id", "_atom_site.B_iso_or_equiv")]
            if places:
                row.append(token)
                if len(row) == len(names):
                    c, r, b = places
                    yield n, row[c] if c is not None else "", int(row[r]), float(row[b])
                    n += 1
                    row = []
    if places and row:
        raise ValueError("a row of atoms is cut off")
    if not n:
        raise ValueError("no atoms")


_ATOMS = pa.schema([("gene_id", pa.string()), ("atom_ord", pa.int64()), ("chain", pa.string()), ("auth_seq_id", pa.int32()), ("b_iso", pa.float64()), ("error", pa.string())])
#: Atoms of a batch; bytes of a model's atoms that stay in memory until it is read to its end.
ATOMS, SPOOL = 1 << 15, 8 << 20


def _table(gene: str, few: list[tuple]) -> pa.RecordBatch:
    k, chain, residue, b = zip(*few, strict=True)
    n = len(few)
    return pa.RecordBatch.from_arrays([pa.array([gene] * n, pa.string()), pa.array(k, pa.int64()), pa.array(chain, pa.string()), pa.array(residue, pa.int32()), pa.array(b, pa.float64()), pa.nulls(n, pa.string())], schema=_ATOMS)


def _atom_batches(gene: str, lines: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """A model's atoms once all of it could be read, or one row with what is wrong with it: nothing of a bad file comes out."""
    with tempfile.SpooledTemporaryFile(SPOOL) as spool:
        try:
            atoms = mmcif_atoms(lines)
            batch = _table(gene, list(islice(atoms, ATOMS)))
            if len(batch) == ATOMS:  # there may be more
                with pa.ipc.new_stream(spool, _ATOMS) as out:
                    out.write(batch)
                    while few := list(islice(atoms, ATOMS)):
                        out.write(_table(gene, few))
        except (ValueError, OverflowError, OSError) as e:
            yield pa.RecordBatch.from_pylist([{"gene_id": gene, "error": f"{type(e).__name__}: {e}"[:500]}], schema=_ATOMS)
            return
        if len(batch) < ATOMS:
            yield batch
            return
        spool.seek(0)
        with pa.ipc.open_stream(spool) as back:
            yield from back


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small models' atoms in batches of many."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= ATOMS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _models(column: str, lines):
    def every(batches):
        for batch in batches:
            for gene, x in zip(batch.column("gene_id").to_pylist(), batch.column(column).to_pylist(), strict=True):
                yield from _atom_batches(gene, lines(x))

    return lambda batches: _joined(every(batches))


def _lines_of(path: str) -> Iterator[str]:
    with opened(path) as f, io.TextIOWrapper(f, "utf-8") as lines:
        yield from lines


_models_of_texts, _models_of_files = _models("value", lambda text: io.StringIO(text or "")), _models("path", _lines_of)

_ATOM_COLUMNS = "gene_id string, atom_ord long, chain string, auth_seq_id int, b_iso double, error string"


def mmcif_rows(models: DataFrame) -> DataFrame:
    """gene_id with value (a model's text) or path (a file, which is read as a stream) -> atoms, and for a model that can't be read one row
    with its error instead. The format's quoting needs a tokenizer, so this one runs in Python."""
    run, column = (_models_of_texts, "value") if "value" in models.columns else (_models_of_files, "path")
    return models.select("gene_id", column).mapInArrow(run, _ATOM_COLUMNS)


def mmcif_table(models: DataFrame) -> DataFrame:
    """The atoms of the models that can be read."""
    return mmcif_rows(models).where("error is null").drop("error")


def mmcif_errors(models: DataFrame) -> DataFrame:
    """gene_id, error of the models that can't."""
    return mmcif_rows(models).where("error is not null").select("gene_id", "error")


def _place(path: Column) -> Column:
    """A path with one form of the local scheme, as Spark's readers give it in two."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def discovered(paths: DataFrame) -> DataFrame:
    """path -> gene_id, path of models; files directly in a folder named seed-... are left out, of equal ids the last path stays."""
    parts = F.split("path", "/")
    f = paths.where(F.element_at(parts, -1).endswith("_model.cif") & ~F.contains(F.element_at(parts, -2), F.lit("seed-")))
    return f.select(extract_id(F.element_at(parts, -1)).alias("gene_id"), "path").groupBy("gene_id").agg(F.max("path").alias("path"))


def discover_files(spark: SparkSession, root: str, pattern: str = "*_model.cif") -> DataFrame:
    """gene_id, path of predictions below root; only names are read."""
    return discovered(listed(spark, root, pattern))


def model_rows(spark: SparkSession, root: str) -> DataFrame:
    """Atoms and errors (see mmcif_rows) of the models below root, one model for each identifier (see discovered)."""
    models = discover_files(spark, root)
    if reachable(root):
        return mmcif_rows(models.repartition(tasks(spark), "path"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_model.cif").text(root, wholetext=True).select("value", _place(F.col("_metadata.file_path")).alias("path"))
    return mmcif_rows(models.withColumn("path", _place(F.col("path"))).join(text, "path").select("gene_id", "value"))


def scan_mmcif(spark: SparkSession, root: str) -> DataFrame:
    """The atoms of the models below root that can be read."""
    return model_rows(spark, root).where("error is null").drop("error")


_SUMMARY = "ptm double, fraction_disordered double, _corrupt_record string"
_PAE = "pae array<array<double>>, _corrupt_record string"


def summary_fields(text: DataFrame) -> DataFrame:
    """gene_id, ptm, fraction_disordered of the texts that can be read; absent ones are null."""
    j = F.from_json("value", _SUMMARY)
    return text.select("gene_id", j.alias("j")).where("j._corrupt_record is null").select("gene_id", "j.ptm", "j.fraction_disordered")


def summary_errors(text: DataFrame) -> DataFrame:
    return text.select("gene_id", F.from_json("value", _SUMMARY).alias("j")).where("j._corrupt_record is not null").select("gene_id", F.lit("unreadable summary").alias("error"))


def pae_rows(text: DataFrame) -> DataFrame:
    """gene_id, row_idx, pae: a row for each row of the matrices that can be read."""
    j = F.from_json("value", _PAE)
    return text.select("gene_id", j.alias("j")).where("j._corrupt_record is null").select("gene_id", F.posexplode("j.pae").alias("row_idx", "pae"))


def pae_errors(text: DataFrame) -> DataFrame:
    """gene_id, error: texts that are no JSON, have no matrix, or hold what is no number."""
    return text.select("gene_id", F.from_json("value", _PAE).alias("j")).where("j._corrupt_record is not null or j.pae is null").select("gene_id", F.lit("unreadable matrix").alias("error"))


def json_texts(files: DataFrame, models: DataFrame) -> DataFrame:
    """path, value of JSON files and gene_id, path of models -> gene_id, value: the files that stand beside the models."""
    parts = F.split("path", "/")
    folder = lambda c: F.array_join(F.slice(F.split(_place(F.col(c)), "/"), 1, F.size(F.split(_place(F.col(c)), "/")) - 1), "/")
    f = files.select(extract_id(F.element_at(parts, -1)).alias("gene_id"), folder("path").alias("folder"), "value")
    return f.join(models.select("gene_id", folder("path").alias("folder")), ["gene_id", "folder"]).select("gene_id", "value")


def scan_json_text(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """gene_id, value: JSON files below root that stand beside the model of their identifier."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return json_texts(t.select(F.col("_metadata.file_path").alias("path"), "value"), discover_files(spark, root))


def scan_metadata_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Of equal ids the last row stays."""
    d = spark.read.csv(path, sep="\t", header=True, schema=METADATA_SCHEMA)
    names = [c for c in d.columns if c != "gene_id"]
    d = d.select(*d.columns, file_order().alias("at"))
    return d.groupBy("gene_id").agg(F.max_by(F.struct(*names), "at").alias("x")).select("gene_id", *(f"x.{c}" for c in names))


def run_metadata(text: DataFrame) -> DataFrame:
    """value: a job's metadata text -> its fields; chains as an array; times with their zone."""
    get = lambda k: F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1)
    when = lambda k: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(get(k), r"^\w{3}\s+", ""), r"\s+", " "), F.lit("MMM d HH:mm:ss z yyyy"))
    chain = r"(?m)^[ \t]*Chain (\w+):\s*(\w+)\s*\((\d+)"
    every = lambda g: F.regexp_extract_all("value", F.lit(chain), F.lit(g))
    return text.select("path", get("Job Name").alias("job_name"), F.arrays_zip(every(1).alias("chain"), every(2).alias("kind"), every(3).cast("array<int>").alias("residues")).alias("chains"), when("Started").alias("started"), when("Finished").alias("finished"))


def scan_run_metadata(spark: SparkSession, root: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.txt").text(root, wholetext=True)
    return run_metadata(t.select(F.input_file_name().alias("path"), "value"))
