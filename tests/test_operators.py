"""Golden values, properties and edge cases of the sequence operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneframe.functions import scalars as S
from geneframe.operators import codon as C
from geneframe.operators import pssm as P
from geneframe.operators import regions as R
from geneframe.operators import splice as J
from geneframe.operators import structure as T
from geneframe.plans import catalog
from geneframe.sources import readers as IN
from geneframe.sources import writers as OUT

# the example acceptor matrix, fixed values
SPLICE = """title: example
uid: 12345678
creation: 2026-03-01 101500
n: 1
comment
\tAn example
pssm 2,3
\tA  0.25 | 1.0 0
\tC  0.75 | 0.0 1
"""


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_uniform_tables(spark):
    ones = C.codon_init(spark, value=1.0)
    total = lambda t: t.agg(F.sum("value")).first()[0]
    assert total(C.codon_frequency(ones)) == 1 and C.codon_frequency(ones).first()["value"] == 1 / 64
    assert total(C.codon_family(ones)) == 244
    assert total(ones) == 64 and total(C.codon_add_scalar(ones, 2)) == 192
    both = C.codon_add_table(ones, C.codon_add_scalar(ones, 2))
    assert total(both) == 256 and total(C.codon_div_scalar(both, 2)) == 128
    sizes = {r["codon"]: r["value"] for r in C.codon_div_table(ones, C.codon_family(ones)).collect()}
    assert sizes["ATG"] == 1 and sizes["CTA"] == 1 / 6


def test_codon_counts(spark):
    s = spark.createDataFrame([("a", "atgGCNtaa"), ("b", "AT"), ("c", None), ("d", "")], "seq_id string, seq string")
    t = C.codon_count(s)
    assert t.count() == 192
    got = {(r["frame"], r["codon"]): r["value"] for r in t.where("value > 0").collect()}
    assert got == {(0, "ATG"): 1, (0, "TAA"): 1, (1, "TGG"): 1, (2, "GGC"): 1}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        C.codon_div_table(t, t, strict=True).collect()
    assert C.codon_preference(t).where("value is null").count() > 0


@pytest.mark.parametrize("n, window, points, old", [(36, 5, 8, 3), (15, 5, 1, 0), (12, 5, 0, 0), (0, 5, 0, 0)])
def test_window_average(spark, n, window, points, old):
    seq = ("ATGGCCTAC" * 10)[:n]
    s = spark.createDataFrame([("a", seq)], "seq_id string, seq string")
    lr = C.genetic_code(spark).select("codon", F.when(F.col("codon") == "ATG", 1.0).otherwise(0.0).alias("lr"))
    got = C.window_average(s, lr, window).orderBy("k").collect()
    values = [seq[i : i + 3] == "ATG" for i in range(0, n - 2, 3)]
    assert [round(r["mean"], 12) for r in got] == [round(sum(values[i : i + window]) / window, 12) for i in range(points)]
    assert C.window_average(s, lr, window, compat=True).count() == old


def test_scalars(spark):
    assert value(spark, S.reverse_complement(F.lit("aACGTN"))) == "NACGTT"
    assert value(spark, S.subsequence(F.lit("ACGTACGT"), F.lit(2), F.lit(3), 5)) == "ACGTACGT"
    assert value(spark, S.subsequence(F.lit("ACGT"), F.lit(9), F.lit(12), 1)) == ""
    assert value(spark, S.delete_base(F.lit("ABCDE"))) == "ABDE"
    assert value(spark, S.log2_floor(F.lit(0.0))) == -10 and value(spark, S.log2_floor(F.lit(8.0))) == 3
    assert np.isnan(value(spark, S.log2_floor(F.lit(-1.0))))
    for name, want in (("X_summary_confidences.json", "X"), ("X_model.cif", "X"), ("X_data.cif.gz", "X"), ("X", "X"), ("a_b_confidences.json", "a_b")):
        assert value(spark, S.extract_id(F.lit(name))) == want
    for p, want in (("G1_mRNA", "G1"), ("G2_id003,G2_id001", "G2"), ("G3,G4", "G3,G4")):
        assert value(spark, S.normalize_parent(F.lit(p))) == want
    assert [value(spark, S.assign_bin(F.lit(n))) for n in (50, 100, 101, 800, 801, 10)] == ["50-100", "50-100", "101-200", "501-800", ">800", ">800"]
    assert len(value(spark, S.uid())) == 8 and len(value(spark, S.now())) == 17


def test_scan_forms_agree(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(4, 15))
    seqs = ["".join(rng.choice(list("ACGT"), 2500)), "ACGT", "A" * 15, "ACGTNACGTACGTACGTACGTACGT", "", None]
    s = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    fast = {(r["seq_id"], r["start"]): r["score"] for r in P.pssm_scan(s, w).collect()}
    slow = {(r["seq_id"], r["start"]): r["score"] for r in P.pssm_scan_sql(s, w, chunk=128).collect()}
    assert fast.keys() == slow.keys() and len(fast) == 2486 + 1 + 11
    for k, seq in enumerate(seqs):
        for i in range(len(seq or "") - 14):
            part = seq[i : i + 15]
            want = None if "N" in part else sum(w["ACGT".index(c), j] for j, c in enumerate(part))
            for got in (fast[k, i], slow[k, i]):
                assert got is None if want is None else abs(got - want) < 1e-12
    with pytest.raises(Exception, match="letter"):
        P.pssm_scan(s, w, strict=True).collect()


def test_pssm_algebra(spark):
    sites = spark.createDataFrame([("d", "ACGT"), ("d", "acgN"), ("d", "AAAN")], "pssm_id string, site string")
    f = P.pssm_frequency(P.pssm_count(sites, 5))
    bits = {r["pos"]: r["bits"] for r in P.pssm_information(f.where("pos < 4")).collect()}
    assert bits[0] == 2 and bits[3] == 2 and 0 < bits[1] < 2
    assert f.where("pos = 4").select(F.isnan("value")).distinct().collect()[0][0]
    assert P.pssm_n(P.pssm_count(sites, 5)).first()["n"] == 3
    assert P.pssm_sharpen(f.where("pos < 4"), 2).groupBy("pos").agg(F.round(F.sum("value"), 9).alias("s")).where("s <> 1").count() == 0
    assert P.pssm_zeros(f).first()["n_zero"] > 0


def test_islands(spark):
    rows = [(i, "c", "exon", 10 * i + 1, 10 * i + 5, "+", p) for i, p in enumerate("aabaaacc")]
    f = spark.createDataFrame(rows, "ord long, seqid string, type string, start long, end long, strand string, parent string")
    g = J.exon_group(f)
    assert [(r["parent"], r["size"]) for r in g.orderBy("ord").select("parent", "size", "island").dropDuplicates(["island"]).orderBy("island").collect()] == [("a", 2), ("a", 3), ("c", 2)]
    assert J.exon_group(f, compat=True).count() == 5
    introns = J.next_exon(g)
    assert introns.count() == 4
    seq = "".join("ACGT"[i % 4] for i in range(100))
    sites = J.junctions(introns, spark.createDataFrame([("c", seq)], "seq_id string, seq string"))
    assert sites.where("length(site) <> 15").count() == 0
    first = introns.orderBy("ord").first()
    donor = sites.where(f"site_type = 'donor' and ord = {first['ord']}").first()
    assert donor is None or donor["site"] == seq[first["this_end"] - 5 : first["this_end"] + 10]


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first > odd\nACG\nTac\n>s2\nGG\n")
    assert {tuple(r) for r in IN.scan_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("s1", "first > odd", "ACGTac"), ("s2", "", "GG")}
    (tmp_path / "g.gff").write_text("##gff\nc\ts\texon\t1\t5\t.\t+\t.\tID=e1;Parent=t1;\nc\ts\tCDS\t2\t4\t.\t-\t.\tParent=G_mRNA;\nshort\tline\n")
    g = IN.scan_gff(spark, str(tmp_path / "g.gff"), ["exon"]).collect()
    assert [(r["start"], r["end"], r["parent"]) for r in g] == [(1, 5, "t1")]
    assert IN.scan_gff_cds(spark, str(tmp_path / "g.gff")).count() == 1
    ordered = C.codon_init(spark, frames=(0,)).withColumn("value", F.expr("20 * instr('TCAG', left(codon, 1)) + 4.0 * instr('TCAG', substr(codon, 2, 1)) + instr('TCAG', right(codon, 1))"))
    values = {r["codon"]: r["value"] for r in ordered.collect()}
    for decimal in (0, 3):
        OUT.sink_codon_table(ordered, str(tmp_path / "t.txt"), decimal=decimal)
        assert {r["codon"]: r["value"] for r in IN.scan_codon_table(spark, str(tmp_path / "t.txt")).collect()} == values
    lines = (tmp_path / "t.txt").read_text().splitlines()
    assert len(lines) == 16 and [x[:3] for x in lines[1].split("  ")] == ["TTC", "TCC", "TAC", "TGC", ""] and lines[0].startswith("TTT:25.000")
    listing = C.codon_listing(ordered).first()["value"].split("\n")
    assert listing[0].endswith(" observations") and listing[1].startswith("   TTT F 25.000    TCT S 29.000 ") and listing[5] == "" and len(listing) == 4 * 5
    cells = spark.createDataFrame([("p", b, j, v) for b in "ACGT" for j, v in enumerate((1.0, 0.5, 2.0))], "pssm_id string, base string, pos int, value double")
    meta = spark.createDataFrame([("p", "t", "u1", "2026-03-01 101500", ["An x", ""])], "pssm_id string, title string, uid string, creation string, comments array<string>")
    OUT.sink_pssm(cells, meta, str(tmp_path / "p.dat"), offset=1)
    got = IN.scan_pssm(spark, str(tmp_path / "p.dat")).orderBy("base", "pos").collect()
    assert [r["value"] for r in got] == [1.0, 0.5, 2.0] * 4 and {r["offset"] for r in got} == {1}
    assert (tmp_path / "p.dat").read_text() == "title: t\nuid: u1\ncreation: 2026-03-01 101500\nn: 8.0\ncomment\n\tAn x\npssm 4,3\n" + "".join(f"\t{b}  1.000      |  0.500  2.000\n" for b in "ACGT")
    back = IN.pssm_meta(spark.read.text(str(tmp_path / "p.dat"), wholetext=True).select(F.lit("p").alias("pssm_id"), "value"))
    assert back.first()["comments"] == ["An x"]
    copy = P.meta_frequency(back).first()
    assert len(copy["uid"]) == 8 and copy["uid"] != "u1" and "copied from u1 (t)" in copy["comments"][1] and copy["comments"][2].endswith("converted to frequency")
    text = spark.createDataFrame([("x", SPLICE)], "pssm_id string, value string")
    assert sorted((r["base"], r["pos"], r["value"]) for r in IN.pssm_entries(text).collect()) == [("A", 0, 0.25), ("A", 1, 1.0), ("A", 2, 0.0), ("C", 0, 0.75), ("C", 1, 0.0), ("C", 2, 1.0)]
    d = tmp_path / "run" / "G1"
    (d / "seed-1").mkdir(parents=True)
    cif = "data_x\nloop_\n_atom_site.id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.B_iso_or_equiv\n1 A 1 50.5\n2 A 1 60\n3 B 1 70\n#\n"
    (d / "G1_model.cif").write_text(cif)
    (d / "seed-1" / "G1_model.cif").write_text(cif)
    (d / "G1_summary_confidences.json").write_text('{"ptm": 0.5}')
    assert IN.discover_files(spark, str(tmp_path / "run")).count() == 1
    got = T.plddt_per_residue(IN.scan_mmcif(spark, str(tmp_path / "run")))
    assert {(r["chain"], r["plddt"]) for r in got.collect()} == {("A", 50.5), ("B", 70.0)}
    s = IN.summary_fields(IN.scan_json_text(spark, str(tmp_path / "run"), "*_summary_confidences.json")).first()
    assert (s["gene_id"], s["ptm"], s["fraction_disordered"]) == ("G1", 0.5, None)
    (d / "metadata.txt").write_text("Job Name:      J1\nChains:        2\n  Chain A: protein (238 residues)\n  Chain B: protein (7 residues)\nStarted:       Fri Feb 27 05:36:21 EST 2026\nFinished:      Fri Feb 27 05:48:13 EST 2026\n")
    r = IN.scan_run_metadata(spark, str(tmp_path / "run")).first()
    assert r["job_name"] == "J1" and [c["residues"] for c in r["chains"]] == [238, 7] and (r["finished"] - r["started"]).seconds == 712


def test_streaming(spark, tmp_path):
    from geneframe.streaming.counts import streaming_codon_count

    spark.createDataFrame([("a", "ATGATG")], "seq_id string, seq string").write.parquet(str(tmp_path / "in"))
    q = streaming_codon_count(spark.readStream.schema("seq_id string, seq string").parquet(str(tmp_path / "in")), (0,)).writeStream.outputMode("complete").format("memory").queryName("codons").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from codons").collect()] == [(0, "ATG", 2)]


def test_queries_match_sql(spark):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    # on so few rows, compiling plans and planning them anew takes most of the time
    plain = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}
    for key, v in plain.items():
        spark.conf.set(key, v)
    try:
        for name, q in catalog.QUERIES.items():
            a, b = q(spark, sf).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
            k = sorted(a.columns)
            assert k == sorted(b.columns), name
            a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
            assert len(a) == len(b) and not ((a != b) & ~(a.isna() & b.isna())).any(axis=None), name
    finally:
        for key in plain:
            spark.conf.unset(key)


def test_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    whole = {r["gene_id"]: len(r["seq"]) for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('G', lpad(doc_id, 9, '0')) as gene_id", "regexp_replace(lower(text), '[^a-z]', '') as seq").collect()}
    got = {r["gene_id"]: r for r in catalog.QUERIES["scan_protein_fasta"](spark, sf).collect()}
    assert {k: len(r["sequence"]) for k, r in got.items()} == {k: r["length_aa"] for k, r in got.items()} == whole and max(whole.values()) > 1000


def test_whole_matrices_and_coding_features(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    assert catalog.QUERIES["scan_pae_json"](spark, sf).count() == 2 * n and catalog.QUERIES["scan_gff_cds"](spark, sf).count() > 0


def test_chunks_give_what_whole_sequences_give(spark):
    rng = np.random.default_rng(3)
    seqs = {"a": "".join(rng.choice(list("ACGT"), 1000)), "b": "ACGTACGTA", "c": "", "d": None, "e": "".join(rng.choice(list("ACGT"), 48))}
    s = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    rows = [(i, k, "exon", int(a), int(a + n), "+-"[i % 2], f"t{i // 3}") for i, (k, a, n) in enumerate((k, rng.integers(1, 1100), rng.integers(0, 300)) for k in "aabceda" for _ in range(12))]
    f = spark.createDataFrame(rows, "ord long, seqid string, type string, start long, end long, strand string, parent string")
    comp = str.maketrans("ACGT", "TGCA")
    for pad in (0, 50):
        got = {r["ord"]: r["region"] for r in R.gene_regions(f, s, pad, size=48).collect()}
        for ord_, seqid, _, a, b, strand, _ in rows:
            seq = seqs[seqid]
            piece = None if seq is None else seq[max(a - pad, 1) - 1 : max(b + pad, 0)]
            assert got[ord_] == (piece if strand == "+" or piece is None else piece[::-1].translate(comp))
        assert got == {r["ord"]: r["region"] for r in R.gene_regions(f, s, pad).collect()}
    introns = spark.createDataFrame([(k, 1, i, "t", "+-"[i % 2], int(a), int(a) + 60) for k in "ae" for i, a in enumerate(rng.integers(0, 990, 80))], "seqid string, island long, ord long, parent string, strand string, this_end long, next_start long")
    small, whole = (sorted(map(tuple, J.junctions(introns, s, size=size).collect())) for size in (48, 3 << 14))
    assert small == whole and len(whole) > 50
    for seqid, _, ord_, strand, kind, site in whole:
        x = introns.where(f"seqid = '{seqid}' and ord = {ord_}").first() if ord_ < 3 else None
        if x is not None and strand == "+" and kind == "donor":
            assert site == seqs[seqid][x["this_end"] - 5 : x["this_end"] + 10]
    w = rng.normal(size=(4, 15))
    scores = [{(r["seq_id"], r["start"]): r["score"] for r in P.pssm_scan(s, w, size=size).collect()} for size in (48, 3 << 14)]
    assert scores[0] == scores[1] and len(scores[0]) == 986 + 34
    cells = spark.createDataFrame([("p", "ACGT"[i], j, float(w[i, j])) for i in range(4) for j in range(15)], "pssm_id string, base string, pos int, value double")
    assert {(r["seq_id"], r["start"]): r["score"] for r in P.pssm_scan(s, cells).collect()} == scores[0]
    sql = {(r["seq_id"], r["start"]): r["score"] for r in P.pssm_scan_sql(s, cells).collect()}
    assert sql.keys() == scores[0].keys() and max(abs(sql[k] - scores[0][k]) for k in sql) < 1e-12
    lr = C.genetic_code(spark).select("codon", (F.xxhash64("codon") % 100 / 100.0).alias("lr"))
    means = [sorted((r["seq_id"], r["k"], r["mean"]) for r in C.window_average(s, lr, 5, size=size).collect()) for size in (48, 3 << 14)]
    assert means[0] == means[1] and len(means[0]) == 333 - 4 + 16 - 4
    values = {r["codon"]: r["lr"] for r in lr.collect()}
    for seq_id, k, mean in means[0]:
        assert abs(mean - sum(values[seqs[seq_id][3 * j : 3 * j + 3]] for j in range(k, k + 5)) / 5) < 1e-12


def test_last_record_wins(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">g1 a SGDID:S1, Chr I from 1-9, Verified ORF\nZZZZ\n>g2 b SGDID:S2, Chr II from 1-9, Dubious ORF\nMK*\n>g1 a SGDID:S1, Chr I from 1-9, Verified ORF\nAC\n")
    assert {r["gene_id"]: r["sequence"] for r in IN.scan_protein_fasta(spark, str(tmp_path / "p.fa")).collect()} == {"g1": "AC", "g2": "MK"}
    (tmp_path / "m.tsv").write_text("gene_id\tcategory\tlength_aa\tn_exons\thas_introns\tlength_bin\tchromosome\tgene_name\ng\tz\t9\t1\tno\t>800\tI\tx\ng\ta\t8\t1\tno\t>800\tI\tx\n")
    assert [(r["category"], r["length_aa"]) for r in IN.scan_metadata_tsv(spark, str(tmp_path / "m.tsv")).collect()] == [("a", 8)]


def test_metric_files(spark, tmp_path):
    plddt = spark.createDataFrame([("g", 10, 50.126), ("g", 2, 3.0), ("h", 1, 1.0)], "gene_id string, residue_number int, plddt double")
    summary = spark.createDataFrame([("g", 0.5, None)], "gene_id string, ptm double, fraction_disordered double")
    pae = spark.createDataFrame([("g", 1, [2.0, 0.005]), ("g", 0, [0.25, 1.0])], "gene_id string, row_idx int, pae array<double>")
    metadata = spark.createDataFrame([("g", "x"), ("i", "y")], "gene_id string, category string")
    texts, errors = T.process_protein(plddt, summary, pae, metadata)
    want = {"plddt.tsv": "residue_number\tplddt\n2\t3.00\n10\t50.13\n", "ptm.tsv": "ptm\n0.5\n", "fraction_disordered.tsv": "fraction_disordered\nNA\n", "pae.tsv": "0.25\t1.00\n2.00\t0.01\n", "metadata.tsv": "gene_id\tcategory\ng\tx\n"}
    assert {r["gene_id"] for r in texts.collect()} == {"g"}
    assert {tuple(r) for r in errors.collect()} == {("h", "no metadata"), ("i", "no model")}
    OUT.sink_metrics_tsv(texts, str(tmp_path / "out"))
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {f"g/{k}": v for k, v in want.items()}
    OUT.sink_metrics(plddt, summary, pae, metadata, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq" / "plddt")).count() == 3


def test_command_line(spark, tmp_path):
    from geneframe.__main__ import main

    (tmp_path / "c.fa").write_text(">a\nATGGCNTAA\n>b\nATGATG\n")
    for flags, kinds in (([], {"frequency"}), (["-c"], {"frequency", "count"}), (["-p"], {"frequency", "count", "preference"})):
        main(["codons", str(tmp_path / "c.fa"), str(tmp_path / "out"), *flags])
        assert {p.name for p in tmp_path.glob("out_rf*")} == {f"out_rf{i}.{k}.txt" for i in range(3) for k in kinds}
    assert "ATG:     3" in (tmp_path / "out_rf0.count.txt").read_text() and "ATG:1.0000" in (tmp_path / "out_rf0.preference.txt").read_text()


def test_numbers_are_printed_as_python_prints_them(spark):
    numbers = [27065132.0, 12345678.5, 1e7, 123456789012345.6, 1e15, 1e16, 1.5e300, 0.0005, 1e-4, 1.5e-5, 0.0, -0.0, -2e7, 8.0, float("nan"), float("inf"), float("-inf")]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(numbers)], "k int, v double")
    assert [r["t"] for r in d.orderBy("k").select(S.shortest(F.col("v")).alias("t")).collect()] == [repr(v) for v in numbers]


def test_a_matrix_of_many_sites_has_its_number_written_out(spark):
    """over ten million sites the number had an exponent."""
    cells = spark.createDataFrame([("p", b, 0, 6766283.0) for b in "ACGT"], "pssm_id string, base string, pos int, value double")
    meta = spark.createDataFrame([("p", "t", "u", "c", [])], "pssm_id string, title string, uid string, creation string, comments array<string>")
    assert "\nn: 27065132.0\n" in P.pssm_text(cells, meta).head()["value"]


def test_uid_query_also_checks_times(spark):
    """F3."""
    rows = catalog.QUERIES["uid"](spark, "/root/testdata/sf0.001").distinct().drop("doc_id").distinct().collect()
    assert [r.asDict() for r in rows] == [{"uid_ok": True, "now_ok": True}]


def _features_read(df):
    return sum("Relation [l_orderkey" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("name", ["pssm_n", "pssm_frequency", "pssm_information", "scan_pssm", "scan_pssm_meta", "sink_pssm"])
def test_models_are_made_once(spark, name):
    """F10, F13 to F18, F20 to F22: features are read twice, by the rows and by the blocks' ends; it was four times and more."""
    assert _features_read(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) == 2


def test_counts_of_odd_sites(spark):
    sites = spark.createDataFrame([("p", "acgt"), ("p", "AN"), ("p", "\u03b1CGTT"), ("q", None), ("r", "")], "pssm_id string, site string")
    got = {(r["pssm_id"], r["base"], r["pos"]): r["value"] for r in P.pssm_count(sites, 3).collect()}
    assert len(got) == 3 * 4 * 3 and {k: v for k, v in got.items() if v} == {("p", "A", 0): 2.0, ("p", "C", 1): 2.0, ("p", "G", 2): 2.0}


def test_counts_of_many_matrices(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 3)
    sites = spark.range(100).selectExpr("cast(id % 20 as string) pssm_id", "'AC' site")
    got = P.pssm_count(sites, 2).collect()
    assert len(got) == 20 * 8 and sorted({(r["base"], r["pos"], r["value"]) for r in got if r["value"]}) == [("A", 0, 5.0), ("C", 1, 5.0)]


def test_scan_by_columns_cuts_no_text_for_a_window(spark):
    """every letter of every window was a substring; now letters are numbers. Matrices wider than a number, letters without a row."""
    rng = np.random.default_rng(5)
    s = spark.createDataFrame([(1, "".join(rng.choice(list("ACGT"), 300)) + "NX\u03b1" + "ACGTTGCA" * 9), (2, "ACG"), (3, None)], "seq_id long, seq string")
    for width in (1, 6, 20, 21, 45):
        w = rng.normal(size=(4, width))
        fast, slow = ({(r["seq_id"], r["start"]): r["score"] for r in f.collect()} for f in (P.pssm_scan(s, w), P.pssm_scan_sql(s, w, chunk=64)))
        assert fast == slow
    assert P.pssm_scan_sql(s, rng.normal(size=(4, 15)))._jdf.queryExecution().optimizedPlan().toString().count("substring(") <= 2


def test_letters_at_each_position(spark):
    """no letter becomes a row."""
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGTN"), k)) for k in (0, 14, 15, 40, 500)]
    s = spark.createDataFrame([*enumerate(seqs), (9, None)], "seq_id long, seq string")
    w = spark.createDataFrame([(b, j, float(j)) for b in "ACGT" for j in range(15)], "base string, pos int, value double")
    want = {}
    for x in seqs:
        for i in range(len(x) - 14):
            for j, b in enumerate(x[i : i + 15]):
                want[j, b] = want.get((j, b), 0) + 1
    d = P.base_weights(s, w, size=48)
    assert {(r["pos"], r["base"]): r["n"] for r in d.collect()} == {k: n for k, n in want.items() if k[1] != "N"}
    assert "split(" not in d._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["exon_group", "exon_group_compat", "next_exon"])
def test_partitions_of_features_grow_with_the_table(spark, monkeypatch, name):
    """a task's rows are bounded, whatever the session's number of partitions."""
    from geneframe.plans import surrogates

    few = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(surrogates, "ROWS", 500)
    many = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    n = surrogates.parts(spark, "/root/testdata/sf0.001")
    assert n == -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500) > 4
    assert many._jdf.queryExecution().optimizedPlan().toString().count(f", {n}") >= 2
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
