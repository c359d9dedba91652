"""python -m geneframe: three programs over files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import assign_bin
from .operators import codon, structure
from .session import session
from .sources import readers, writers
from .sources.fasta import scan_fasta_chunks


def codons(spark, a: argparse.Namespace) -> None:
    """Codons of a FASTA file in three frames, a file each: frequencies, or with -c counts, with -p preferences."""
    chunks = scan_fasta_chunks(spark, a.sequences, overlap=2)
    counts = codon.codon_count_chunks(chunks)
    if a.counts:
        writers.sink_codon_batch(counts, a.prefix, "count")
    if a.preference:
        writers.sink_codon_batch(codon.codon_preference(counts), a.prefix, "preference")
    if not a.counts and not a.preference:
        writers.sink_codon_batch(codon.codon_frequency(counts), a.prefix, "frequency")


def sample(spark, a: argparse.Namespace) -> DataFrame:
    """A stratified sample of proteins: an input document for each, and a table of them."""
    proteins = structure.known_category(readers.scan_protein_fasta(spark, a.proteins))
    proteins = structure.join_exon_counts(proteins, structure.exon_count_by_gene(readers.scan_gff_cds(spark, a.features)))
    chosen = structure.stratified_sample(proteins.withColumn("length_bin", assign_bin(F.col("length_aa"))), seed=a.seed)
    writers.sink_json(structure.predictor_text(chosen), a.inputs)
    writers.sink_sample_tsv(structure.sample_metadata(chosen), a.table)
    return chosen


def metrics(spark, a: argparse.Namespace) -> None:
    """The confidence metrics of all predictions below a folder, a file each; what fails is told and the rest goes on."""
    models = readers.model_rows(spark, a.predictions).persist()
    plddt = structure.plddt_per_residue(models.where("error is null").drop("error"))
    summary, pae = (readers.scan_json_text(spark, a.predictions, p) for p in ("*_summary_confidences.json", "*[!y]_confidences.json"))
    unreadable = models.where("error is not null").select("gene_id", "error").unionByName(readers.summary_errors(summary)).unionByName(readers.pae_errors(pae))
    lines, errors = structure.process_protein(plddt, readers.summary_fields(summary), readers.pae_rows(pae), readers.scan_metadata_tsv(spark, a.table), unreadable)
    writers.sink_metrics_tsv(lines, f"{a.out}/metrics")
    errors.write.mode("overwrite").csv(f"{a.out}/_errors", sep="\t", header=True)
    models.unpersist()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geneframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("codons", help=codons.__doc__)
    c.add_argument("sequences")
    c.add_argument("prefix")
    c.add_argument("-c", "--counts", action="store_true", help="counts")
    c.add_argument("-p", "--preference", action="store_true", help="shares in the family of the amino acid")
    c.set_defaults(run=codons)
    s = sub.add_parser("sample", help=sample.__doc__)
    for name in ("proteins", "features", "inputs", "table"):
        s.add_argument(name)
    s.add_argument("--seed", type=int, default=42)
    s.set_defaults(run=sample)
    m = sub.add_parser("metrics", help=metrics.__doc__)
    for name in ("predictions", "out", "table"):
        m.add_argument(name)
    m.set_defaults(run=metrics)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
