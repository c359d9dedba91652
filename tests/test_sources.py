"""Files read in ranges, streams and by fault-isolating readers; files written by name; exact decimals; blocks of features."""

import json
import random
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from geneframe.functions.scalars import fixed
from geneframe.operators import codon as C
from geneframe.operators import splice as J
from geneframe.operators import structure as T
from geneframe.operators.chunks import chunked
from geneframe.sources import files
from geneframe.sources import readers as IN
from geneframe.sources.fasta import ranges, scan_fasta_chunks


def whole(spark, path, size, overlap):
    s = IN.scan_fasta(spark, path).select(F.struct("seq_id", "doc").alias("seq_id"), "seq")
    return sorted(tuple(r) for r in chunked(s, size, overlap).select("seq_id.seq_id", "seq_id.doc", "chunk", "part", "length").collect())


def in_ranges(spark, path, size, overlap, each):
    return sorted(tuple(r) for r in scan_fasta_chunks(spark, path, size, overlap, each).select("seq_id", "doc", "chunk", "part", "length").collect())


def test_fasta_ranges(spark, tmp_path):
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("ACGTacgtN") for _ in range(n))
    wrap = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    records = [("one a description > with a mark", wrap(letters(300), 60)), ("two", letters(500)), ("none", ""), ("three  spaced ", wrap(letters(48), 7)), ("four", "\n\n" + wrap(letters(97), 10) + "\n\n"), ("five " + "long " * 30, letters(1)), ("none2 x", "")]
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{s}\n" for h, s in records))
    (tmp_path / "b.fa").write_text(f">six\n{wrap(letters(200), 33)}\n>seven last\n{letters(20)}")
    path = str(tmp_path / "*.fa")
    for size, overlap in ((12, 2), (48, 14), (1 << 10, 0)):
        want = whole(spark, path, size, overlap)
        assert len({w[0] for w in want}) == 9
        for each in (7, 50, 333, 1 << 20):
            assert in_ranges(spark, path, size, overlap, each) == want, (size, each)


def test_one_long_record_in_many_ranges(spark, tmp_path):
    """A record of one line is read by as many tasks as it has ranges, each with its share of the chunks."""
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(1000)) * 8000
    (tmp_path / "x.fa").write_text(f">chr\n{seq}\n")
    path = str(tmp_path / "x.fa")
    assert ranges(spark, path, 1 << 20).count() == 8
    got = scan_fasta_chunks(spark, path, 3 << 14, 2, 1 << 20)
    tasks = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) <= 22
    parts = {r["chunk"]: r["part"] for r in got.collect()}
    assert all(p == seq[k * (3 << 14) : (k + 1) * (3 << 14) + 2] for k, p in parts.items()) and len(parts) == -(-len(seq) // (3 << 14))
    counts = {(r["frame"], r["codon"]): r["value"] for r in C.codon_count_chunks(got).where("value > 0").collect()}
    for f in range(3):
        assert sum(v for (g, _), v in counts.items() if g == f) == (len(seq) - f) // 3


def test_codons_by_phase(spark):
    r = random.Random(3)
    seqs = ["".join(r.choice("ACGTacgtN") for _ in range(n)) for n in (0, 1, 2, 3, 5, 11, 12, 13, 14, 26, 100, 101)]
    s = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    want = {}
    for x in seqs:
        for f in range(3):
            for i in range(f, len(x) - 2, 3):
                c = x[i : i + 3].upper()
                if "N" not in c:
                    want[f, c] = want.get((f, c), 0) + 1
    for size in (3, 12, 3 << 14):
        got = C.codon_count_chunks(chunked(s, size, 2), size=size).where("value > 0").collect()
        assert {(x["frame"], x["codon"]): x["value"] for x in got} == want
    with pytest.raises(ValueError, match="frame"):
        C.codon_count(s, (3,))


def test_tables_by_identifier(spark):
    a, b = (C.codon_init(spark, "x", (0,), v).unionByName(C.codon_init(spark, "y", (0,), 10 * v)) for v in (1.0, 2.0))
    assert {(r["table_id"], r["value"]) for r in C.codon_add_table(a, b).collect()} == {("x", 3.0), ("y", 30.0)} and C.codon_add_table(a, b).count() == 128
    assert {r["value"] for r in C.codon_div_table(a, C.codon_init(spark, "z", (0,), 2.0), by=("frame",)).collect()} == {0.5, 5.0}


def islands_of(rows):
    """(seqid, ord) -> island, place, size, whether the island is the seqid's last, next start in the island."""
    out = {}
    for seqid in {r[1] for r in rows}:
        own, runs = sorted(r for r in rows if r[1] == seqid), []
        for r in own:
            if not runs or runs[-1][-1][6] != r[6]:
                runs.append([])
            runs[-1].append(r)
        place = 0
        for k, run in enumerate(runs):
            for i, r in enumerate(run):
                place += 1
                out[seqid, r[0]] = (k + 1, place, len(run), k == len(runs) - 1, run[i + 1][3] if i + 1 < len(run) else None)
    return out


@pytest.mark.parametrize("bits", [0, 1, 3, 16])
def test_features_in_blocks(spark, bits):
    r = random.Random(6)
    rows, at = [], 0
    for seqid in ("a", "b", None):
        parent = None
        for _ in range(120):
            at += r.choice((1, 1, 2, 7))
            parent = parent if r.random() < 0.7 else r.choice(("p", "q", None, f"t{at}"))
            rows.append((at, seqid, "exon", at * 10, at * 10 + 5, "+", parent))
    rows += [(at + 1 + k, "c", "exon", k, k + 1, "-", "long") for k in range(70)]
    f = spark.createDataFrame(rows, "ord long, seqid string, type string, start long, end long, strand string, parent string").repartition(5)
    want = islands_of(rows)
    got = {(x["seqid"], x["ord"]): (x["island"], x["place"], x["changed"]) for x in J.carried(f, bits).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(changed == (k not in want or i == 1 and p == 1 or any(w[0] == i - 1 and w[1] == p - 1 for q, w in want.items() if q[0] == k[0])) for k, (i, p, changed) in got.items())
    for compat in (False, True):
        g = {(x["seqid"], x["ord"]): (x["island"], x["size"]) for x in J.exon_group(f, compat, bits).collect()}
        assert g == {k: (v[0], v[2]) for k, v in want.items() if v[2] > 1 and not (compat and v[3])}
    starts = {k: v[4] for k, v in want.items() if v[4] is not None}
    for introns in (J.introns(f, bits), J.next_exon(J.exon_group(f, bits=bits), bits)):
        assert {(x["seqid"], x["ord"]): x["next_start"] for x in introns.collect()} == starts
    s = f.withColumn("ord", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("ord").alias("row")))
    assert {(x["seqid"], x["ord"]["row"]): x["size"] for x in J.exon_group(s, bits=bits).collect()} == {k: v[2] for k, v in want.items() if v[2] > 1}


def test_sample_sends_few_rows(spark):
    import hashlib

    r = random.Random(2)
    rows = [(f"g{k}", r.choice("xyz"), r.choice(("s", "l")), r.choice((1, 1, 2))) for k in range(900)] + [("h", "w", "s", 2), ("i", "w", "s", 1)]
    p = spark.createDataFrame(rows, "gene_id string, category string, length_bin string, n_exons int").repartition(6)
    key = lambda g: (hashlib.md5(f"{g}-42".encode()).hexdigest(), g)
    want = set()
    for c in {x[1] for x in rows}:
        forced = {x[0] for x in sorted((x for x in rows if x[1] == c and x[3] > 1), key=lambda x: key(x[0]))[:3]}
        for b in {x[2] for x in rows if x[1] == c}:
            own = sorted((x for x in rows if x[1:3] == (c, b)), key=lambda x: (x[0] not in forced, key(x[0])))
            want |= {(x[0], x[0] in forced) for i, x in enumerate(own) if i < 20 or x[0] in forced}
    d = T.stratified_sample(p)
    assert {(x["gene_id"], x["is_forced"]) for x in d.collect()} == want
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after the shuffle, for forced genes and for bins


def test_places_in_strata(spark):
    r = random.Random(8)
    rows = [(f"g{r.randrange(10**6)}", r.choice(("x", "x", "x", None)), r.choice("sl")) for _ in range(3000)]
    got = T.strata(spark.createDataFrame(rows, "gene_id string, category string, length_bin string").repartition(7)).collect()
    want = {}
    for c, b, g in sorted(((c, b, g) for g, c, b in rows), key=lambda x: (x[0] or "", x[1], x[2])):
        want.setdefault((c, b), []).append(g)
    assert {k: [g for _, g in sorted((x["place"], x["gene_id"]) for x in got if (x["category"], x["length_bin"]) == k)] for k in want} == want
    assert all(sorted(x["place"] for x in got if (x["category"], x["length_bin"]) == k) == list(range(1, len(v) + 1)) for k, v in want.items())


def test_exact_decimals(spark):
    r = random.Random(1)
    v = [0.0625, 0.125, 2.675, 0.5, 1.5, 2.5, 0.0, -0.0, -0.001, float("nan"), float("inf"), float("-inf"), None, 1e22, 123456789012345678.0, 2.0**62, 2.0**125, 5e-324, 0.005, -2.675, 999.9995]
    v += [r.uniform(-1, 1) for _ in range(3000)] + [r.uniform(0, 1e6) for _ in range(3000)] + [r.randrange(4000) / 64 for _ in range(2000)] + [struct.unpack("d", struct.pack("Q", r.randrange(0x3000000000000000, 0x47C0000000000000)))[0] for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for n in (0, 2, 3, 5):
        got = df.select(fixed(F.col("x"), n).alias("a"), fixed(F.col("x"), n, 7).alias("b")).collect()
        assert [(g["a"], g["b"]) for g in got] == [(None, None) if x is None else (f"{x:.{n}f}", f"{x:7.{n}f}") for x in v]


def test_traditional_tables(spark):
    """The listing and the file as the formats say them, with ties of rounding."""
    aa = {r["codon"]: r["aa"] for r in C.genetic_code(spark).collect()}
    t = C.codon_init(spark).withColumn("value", F.ascii("codon") / 16.0 + F.ascii(F.substring("codon", 2, 1)) / 64.0)
    v = {r["codon"]: r["value"] for r in t.collect()}
    listing, table = f"{sum(v.values()):.3f} observations\n", ""
    for a in "TCAG":
        for c in "TCAG":
            codons = [f"{a}{b}{c}" for b in "TCAG"]
            listing += "".join(f"   {x} {aa[x]} {v[x]:6.3f} " for x in codons) + "\n"
            table += "".join(f"{x}:{v[x]:6.3f}  " for x in codons) + "\n"
        listing += "\n"
    assert C.codon_listing(t).first()["value"] == listing.rstrip() and C.codon_text(t).first()["value"] == table


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"g{k % 7}/x.tsv", k, f"line {k}\n") for k in range(500)] + [("top.txt", 1, ""), ("g1/é.tsv", 1, "ü\n")]
    df = spark.createDataFrame(rows, "path string, place long, value string").repartition(9)
    files.write_named(df, folder)
    found = {p.relative_to(folder).as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {n: "".join(v for q, _, v in sorted(rows, key=lambda r: r[1]) if q == n) for n in {r[0] for r in rows}}
    bad = spark.createDataFrame([("g1/x.tsv", 1, "new"), ("../y", 1, "z")], "path string, place long, value string")
    with pytest.raises(Exception, match="no path below"):
        files.write_named(bad, folder)
    after = {p.relative_to(folder).as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert after == found  # nothing new, nothing half, nothing staged
    with pytest.raises(ValueError, match="store"):
        files.write_named(df, "viewfs://x/y")


CIF = "data_x\n_entry.id 'a b'\n;a text\nloop_\n;\nloop_\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.B_iso_or_equiv\n"


def test_models(tmp_path):
    text = CIF + "1 'C A' A 1 50.5\n2 \"O5'\" A\n1 60 # note\n3\n;C\n;\nB 1 70\n#\nloop_\n_other.id\n1\n2\n"
    assert list(IN.mmcif_atoms(text.splitlines(keepends=True))) == [(0, "A", 1, 50.5), (1, "A", 1, 60.0), (2, "B", 1, 70.0)]
    for broken in (CIF + "1 C A 1", CIF + "1 C A x 5.0\n", CIF + "1 C A 1 5.0.0\n", CIF + "1 C A 1 5.0\n;open text\n", "data_x\n", ""):
        with pytest.raises(ValueError):
            list(IN.mmcif_atoms(broken.splitlines(keepends=True)))
    lines = lambda: iter([CIF, *(f"{k} 'C A' A {k // 8} {k % 100}.25\n" for k in range(200_000))])
    tracemalloc.start()
    n = sum(len(b) for b in IN._atom_batches("g", (x for part in lines() for x in part.splitlines(keepends=True))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 40 << 20


@pytest.fixture(scope="module")
def predictions(tmp_path_factory):
    """Two sound proteins (one with two chains, and an older model), and five that fail each in its own way."""
    root = tmp_path_factory.mktemp("run")

    def put(gene, cif, summary='{"ptm": 0.5}', pae='{"pae": [[0.125, 1], [2.675, 0]]}', at="z"):
        d = root / at / gene
        d.mkdir(parents=True)
        (d / f"{gene}_model.cif").write_text(cif)
        for name, text in (("summary_confidences", summary), ("confidences", pae)):
            if text is not None:
                (d / f"{gene}_{name}.json").write_text(text)

    put("G1", CIF + "1 C A 1 50.125\n2 C A 1 9\n3 C A 2 60\n")
    put("G1", CIF + "1 C A 1 1\n", '{"ptm": 0.1}', at="a")
    put("G2", CIF + "1 C A 1 50\n2 C B 1 70\n", '{"ptm": 0.75, "fraction_disordered": 0.25}', None)
    put("B1", CIF + "1 C A 1")
    put("B2", CIF + "1 C A x 5.0\n")
    put("B3", CIF + "1 C A 1 5.0\n", summary='{"ptm": 0.5')
    put("B4", CIF + "1 C A 1 5.0\n", pae='{"pae": [[0.5, "x"]]}')
    put("B5", CIF + "1 C A 1 5.0\n", pae="{}")
    (root / "meta.tsv").write_text("gene_id\tcategory\tlength_aa\tn_exons\thas_introns\tlength_bin\tchromosome\tgene_name\n" + "".join(f"{g}\tVerified\t2\t1\tno\t>800\tI\tn\n" for g in ("G1", "G2", "B1", "B2", "B3", "B4", "B5", "M1")))
    return root


def test_metrics_program(spark, predictions, tmp_path):
    from geneframe.__main__ import main

    main(["metrics", str(predictions), str(tmp_path / "out"), str(predictions / "meta.tsv")])
    top = tmp_path / "out" / "metrics"
    found = {p.relative_to(top).as_posix(): p.read_text() for p in top.rglob("*") if p.is_file()}
    meta = "gene_id\tcategory\tlength_aa\tn_exons\thas_introns\tlength_bin\tchromosome\tgene_name\n{}\tVerified\t2\t1\tno\t>800\tI\tn\n"
    assert found == {
        "G1/plddt.tsv": "residue_number\tplddt\n1\t50.12\n2\t60.00\n", "G1/ptm.tsv": "ptm\n0.5\n", "G1/fraction_disordered.tsv": "fraction_disordered\nNA\n", "G1/pae.tsv": "0.12\t1.00\n2.67\t0.00\n", "G1/metadata.tsv": meta.format("G1"),
        "G2/plddt.tsv": "chain\tresidue_number\tplddt\nA\t1\t50.00\nB\t1\t70.00\n", "G2/ptm.tsv": "ptm\n0.75\n", "G2/fraction_disordered.tsv": "fraction_disordered\n0.25\n", "G2/metadata.tsv": meta.format("G2"),
    }
    errors = {r["gene_id"]: r["error"] for r in spark.read.csv(str(tmp_path / "out" / "_errors"), sep="\t", header=True).collect()}
    assert set(errors) == {"B1", "B2", "B3", "B4", "B5", "M1"}
    assert "cut off" in errors["B1"] and "ValueError" in errors["B2"] and errors["B3"] == "unreadable summary" and errors["B4"] == errors["B5"] == "unreadable matrix" and errors["M1"] == "no model"


def test_predictor_files(spark, tmp_path):
    from geneframe.sources import writers as OUT

    rows = [("G1", "Verified", 3, 2, "II", "MKV"), ('G"2', "Dubious", 1, 1, "", "A\\")]
    p = spark.createDataFrame(rows, "gene_id string, category string, length_aa int, n_exons int, chromosome string, sequence string")
    OUT.sink_json(T.predictor_text(p), str(tmp_path / "in"))
    for gene, category, n, exons, chromosome, seq in rows:
        doc = {"name": gene, "modelSeeds": [1], "sequences": [{"protein": {"id": "A", "sequence": seq, "description": f"{category} | {exons} exons | {n} AA | {chromosome}"}}], "dialect": "alphafold3", "version": 4}
        assert (tmp_path / "in" / f"{gene}.json").read_text() == json.dumps(doc, indent=2)
    assert json.loads(T.predictor_input(p).where("gene_id = 'G1'").first()["json"])["version"] == 4


def _tasks(spark, name, run):
    """Tasks of the jobs that run() starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return sum(x.numTasks for x in map(tracker.getStageInfo, stages) if x)


def test_many_folders_take_few_tasks(spark, tmp_path):
    for k in range(300):
        d = tmp_path / "run" / "b" / f"p{k}"
        d.mkdir(parents=True)
        (d / f"p{k}_model.cif").write_text(CIF + ("1 C A 1 50.5\n2 C A 2 60\n" if k else "1 C A x 5.0\n"))
    for hidden in ("_staging/p1", ".old/p2"):
        (tmp_path / "run" / hidden).mkdir(parents=True)
        (tmp_path / "run" / hidden / "p_model.cif").write_text("")
    root = f"file://{tmp_path}/run"
    found = {r["path"] for r in files.listed(spark, root, "*_model.cif").collect()}
    assert found == {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").collect()} and len(found) == 300
    got = []
    assert _tasks(spark, "models", lambda: got.extend(IN.model_rows(spark, root).collect())) < 200
    assert len(got) == 599 and [r["gene_id"] for r in got if r["error"]] == ["p0"]


def test_small_models_share_a_batch():
    import pyarrow as pa

    texts = [CIF + "1 C A 1 50.5\n", CIF + "1 C A x 5.0\n", *[CIF + f"1 C A {k} 60\n" for k in range(98)]]
    table = pa.RecordBatch.from_pydict({"gene_id": [f"g{k}" for k in range(100)], "value": texts})
    out = list(IN._models_of_texts([table]))
    assert len(out) == 1 and out[0].num_rows == 100 and [r["gene_id"] for r in out[0].to_pylist() if r["error"]] == ["g1"]


def test_commit_joins_folders_of_tasks(tmp_path):
    root = tmp_path / "out"
    (root / "b/x").mkdir(parents=True)
    (root / "b/x/1").write_text("old")
    w = files._NamedFiles(f"file://{root}")
    staged = []
    for k, names in enumerate((("a/x/1", "b/x/1"), ("a/x/2", "b/y/1", "c"))):
        top = root / "_staging" / w.job / str(k)
        for n in names:
            (top / n).parent.mkdir(parents=True, exist_ok=True)
            (top / n).write_text(f"{k}{n}")
        staged.append(files._Written(str(top)))
    w.commit([*staged, None, files._Written(str(root / "_staging" / w.job / "9"))])
    assert {p.relative_to(root).as_posix(): p.read_text() for p in root.rglob("*") if p.is_file()} == {"a/x/1": "0a/x/1", "b/x/1": "0b/x/1", "a/x/2": "1a/x/2", "b/y/1": "1b/y/1", "c": "1c"}
    assert not (root / "_staging").exists()


def test_many_small_texts_take_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / "run" / f"p{k}").mkdir(parents=True)
        (tmp_path / "run" / f"p{k}" / "ptm.tsv").write_text("" if k == 0 else f"ptm\n{k} é\n")
    root, got = f"file://{tmp_path}/run", []
    assert _tasks(spark, "texts", lambda: got.extend(files.whole_texts(spark, root).collect())) < 200
    old = spark.read.text(root, wholetext=True, recursiveFileLookup=True).collect()
    assert sorted(r["value"] for r in got) == sorted(r["value"] for r in old) and {r["path"].split("/")[-2] for r in got} == {f"p{k}" for k in range(1, 300)}


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">s{k}\n{'ACGT' * 15}\n" for k in range(300)))
    path, got = f"file://{tmp_path}/a.fa", []
    assert ranges(spark, path, 64).count() > 300
    assert _tasks(spark, "chunks", lambda: got.extend(scan_fasta_chunks(spark, path, 30, 3, 64).collect())) < 100
    assert sorted((r["seq_id"], r["chunk"], r["part"], r["length"]) for r in got) == sorted((f"s{k}", c, ("ACGT" * 15)[c * 30 : c * 30 + 33], 60) for k in range(300) for c in range(2))


def test_likelihood_makes_no_row_of_a_window(spark):
    import numpy as np
    import pyarrow as pa

    from geneframe.functions.scalars import exp2
    from geneframe.operators import pssm as P

    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ACGT" if k % 3 else "ACGTN") for _ in range(n))) for k, n in enumerate((0, 4, 5, 6, 29, 30, 31, 34, 35, 200, 1000))] + [(90, None), (91, "N" * 40)]
    s, w = spark.createDataFrame(rows, "seq_id long, seq string"), np.array([[rng.uniform(-10, 0) for _ in range(5)] for _ in range(4)])
    want = P.pssm_scan(s, w, size=30).groupBy("seq_id").agg(F.max(exp2(F.col("score"))).alias("x"))
    round9 = lambda d: {(r[0], None if r[1] is None else round(r[1], 12)) for r in d.collect()}
    assert round9(P.pssm_likelihood(s, w, size=30)) == round9(want) and want.count() == 10
    batch = pa.RecordBatch.from_pydict({"seq_id": [1, 2], "chunk": [0, 0], "part": ["ACGT" * 50, "AC"], "w": [w.ravel().tolist()] * 2})
    assert [len(b) for b in P._likelihoods("ACGT", False)([batch])] == [1]
