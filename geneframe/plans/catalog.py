"""Queries of the sequence operators over the driver's tables, with the same in SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import codon as C
from ..operators import pssm as P
from ..operators import regions as R
from ..operators import splice as J
from ..operators import structure as T
from ..session import scratch
from ..sources import readers as IN
from ..sources import writers as OUT
from ..sources.fasta import scan_fasta_chunks
from ..sources.files import whole_texts, write_named
from .surrogates import S1, S2, S4, features, parts, proteins, residues, sequences

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Codon tables

_CODES = ", ".join(f"('{''.join(c)}', '{a}')" for c, a in zip(product(C.BASES, repeat=3), C.AMINO, strict=True))
CODE = f"code AS (SELECT * FROM (VALUES {_CODES}) v(codon, aa))"
COUNT = f"""{S1}, {CODE}, fr AS (SELECT unnest([0, 1, 2]) AS frame),
 raw AS (SELECT frame, unnest(regexp_extract_all(substr(seq, frame + 1), '...')) AS codon FROM s1, fr), cnt AS (SELECT frame, codon, count(*)::DOUBLE AS n FROM raw GROUP BY ALL),
 t AS (SELECT fr.frame, code.codon, code.aa, coalesce(n, 0)::DOUBLE AS value FROM fr CROSS JOIN code LEFT JOIN cnt ON cnt.frame = fr.frame AND cnt.codon = code.codon)"""
FREQ = COUNT + ", f AS (SELECT frame, codon, aa, value / nullif(sum(value) OVER (PARTITION BY frame), 0) AS value FROM t)"
LR = FREQ + """, r AS (SELECT codon, sum(CASE WHEN frame = 0 THEN value ELSE 0 END) / nullif(sum(CASE WHEN frame = 0 THEN value ELSE 0 END) + sum(CASE WHEN frame = 1 THEN value ELSE 0 END) + sum(CASE WHEN frame = 2 THEN value ELSE 0 END), 0) AS r FROM f GROUP BY codon),
 lr AS (SELECT codon, r / sum(r) OVER () AS lr FROM r)"""


def _counts(spark, d):
    return C.codon_count(sequences(spark, d))


def _table(df):
    return rounded(df, "value").select("frame", "codon", "value")


for _key, _make, _sql in (
    ("codon_count_3frames", lambda t: t, f"WITH {COUNT} SELECT frame, codon, value FROM t"),
    ("codon_frequency", C.codon_frequency, f"WITH {FREQ} SELECT frame, codon, round(value, 9) AS value FROM f"),
    ("codon_family", C.codon_family, f"WITH {COUNT} SELECT frame, codon, sum(value) OVER (PARTITION BY frame, aa) AS value FROM t"),
    ("codon_preference", C.codon_preference, f"WITH {COUNT} SELECT frame, codon, round(value / nullif(sum(value) OVER (PARTITION BY frame, aa), 0), 9) AS value FROM t"),
    ("codon_pseudocount", C.codon_pseudocount, f"WITH {COUNT} SELECT frame, codon, value + 1 AS value FROM t"),
    ("codon_add_scalar", lambda t: C.codon_add_scalar(t, 2.5), f"WITH {COUNT} SELECT frame, codon, value + 2.5 AS value FROM t"),
    ("codon_div_scalar", lambda t: C.codon_div_scalar(t, 4), f"WITH {COUNT} SELECT frame, codon, value / 4 AS value FROM t"),
    ("codon_add_table", lambda t: C.codon_add_table(t, C.codon_family(t)), f"WITH {COUNT} SELECT frame, codon, value + sum(value) OVER (PARTITION BY frame, aa) AS value FROM t"),
    ("codon_div_table", lambda t: C.codon_div_table(t, C.codon_family(t)), f"WITH {COUNT} SELECT frame, codon, round(value / nullif(sum(value) OVER (PARTITION BY frame, aa), 0), 9) AS value FROM t"),
):
    query(_sql, _key)(lambda spark, d, make=_make: _table(make(_counts(spark, d))))


@query(f"WITH {CODE} SELECT doc_id AS table_id, codon, aa, 0.0::DOUBLE AS value, count(*) OVER (PARTITION BY doc_id, aa)::INTEGER AS family_size FROM documents, code")
def codon_init(spark, d):
    """An empty table for each document, as counting starts from."""
    ids = sequences(spark, d).select(F.col("seq_id").alias("table_id"))
    return C.codon_init_each(ids, (0,)).join(F.broadcast(C.genetic_code(spark)), "codon").select("table_id", "codon", "aa", "value", "family_size")


@query(f"WITH {COUNT} SELECT codon, value FROM t WHERE frame = 0")
def codon_count(spark, d):
    return C.codon_count(sequences(spark, d), (0,)).select("codon", "value")


@query(f"WITH {S1} SELECT count(*) AS n, sum(length(seq))::BIGINT AS bases FROM s1")
def seq_count(spark, d):
    return C.sequence_count(sequences(spark, d))


@query(f"WITH {COUNT} SELECT frame, codon, aa, value FROM t")
def join_codon_aa(spark, d):
    return C.with_amino(_counts(spark, d)).select("frame", "codon", "aa", "value")


@query(f"WITH {COUNT} SELECT frame, aa, sum(value) AS total FROM t GROUP BY ALL")
def join_family(spark, d):
    return C.family_total(_counts(spark, d))


@query(f"WITH {LR} SELECT codon, round(lr, 9) AS lr FROM lr")
def coding_lr(spark, d):
    return rounded(C.coding_lr(_counts(spark, d)), "lr")


_PROFILE = f"""{LR}, cod AS (SELECT seq_id, unnest(regexp_extract_all(seq, '...')) AS codon, unnest(range(0, len(regexp_extract_all(seq, '...')))) AS k, length(seq) AS size FROM s1),
 p AS (SELECT seq_id, k, size, lr.lr FROM cod JOIN lr USING (codon)),
 wa AS (SELECT seq_id, k, size, sum(lr) OVER (PARTITION BY seq_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) / 5 AS mean, count(*) OVER (PARTITION BY seq_id) - 5 AS last FROM p)"""


@query(f"WITH {_PROFILE} SELECT seq_id, count(*) AS n, round(sum(lr), 6) AS total FROM p GROUP BY seq_id")
def join_codon_lr(spark, d):
    p = C.codon_profile(sequences(spark, d), C.coding_lr(_counts(spark, d)))
    return rounded(p.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("lr").alias("total")), "total", digits=6)


@query(f"WITH {_PROFILE} SELECT seq_id, k, k + 2.0::DOUBLE AS x, round(mean, 9) AS mean FROM wa WHERE k <= last")
def window_average(spark, d):
    return rounded(C.window_average(sequences(spark, d), C.coding_lr(_counts(spark, d)), 5), "mean")


@query(f"WITH {_PROFILE} SELECT seq_id, k, k + 2.0::DOUBLE AS x, round(mean, 9) AS mean FROM wa WHERE k <= last AND size > 30 AND k <= ceil((size - 30) / 3)")
def window_average_compat(spark, d):
    return rounded(C.window_average(sequences(spark, d), C.coding_lr(_counts(spark, d)), 5, compat=True), "mean")


# Scalars


@query(f"WITH {S1} SELECT seq_id, reverse(translate(upper(seq), 'ACGT', 'TGCA')) AS rc FROM s1")
def reverse_complement(spark, d):
    return sequences(spark, d).select("seq_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {S1} SELECT seq_id, upper(lower(seq)) AS u FROM s1")
def seq_upper(spark, d):
    return sequences(spark, d).select("seq_id", S.seq_upper(F.lower("seq")).alias("u"))


@query(f"WITH {S1}, fr AS (SELECT unnest([0, 1, 2]) AS frame) SELECT seq_id, frame, len(regexp_extract_all(substr(seq, frame + 1), '...'))::INTEGER AS n FROM s1, fr")
def codon_split(spark, d):
    s = sequences(spark, d).select("seq_id", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"))
    return s.select("seq_id", "frame", F.size(S.codon_split(F.col("seq"), F.col("frame"))).alias("n"))


@query(f"WITH {S1} SELECT seq_id, substr(seq, 1, length(seq) // 2) || substr(seq, length(seq) // 2 + 2) AS cut FROM s1")
def delete_base(spark, d):
    return sequences(spark, d).select("seq_id", S.delete_base(F.col("seq")).alias("cut"))


@query(f"WITH {S4} SELECT gene_id, length_bin FROM s4b")
def assign_bin(spark, d):
    return _proteins(spark, d).select("gene_id", "length_bin")


@query(f"WITH {S4} SELECT gene_id, CASE WHEN n_exons > 1 THEN 'yes' ELSE 'no' END AS has_introns FROM s4")
def has_introns(spark, d):
    return proteins(spark, d).select("gene_id", S.has_introns(F.col("n_exons")).alias("has_introns"))


@query(f"WITH {S4} SELECT gene_id, category || ' | ' || n_exons || ' exons | ' || length_aa || ' AA | ' || chromosome AS text FROM s4", "af3_description")
def af3_description(spark, d):
    return proteins(spark, d).select("gene_id", S.description(*map(F.col, ("category", "n_exons", "length_aa", "chromosome"))).alias("text"))


@query(f"WITH {S4} SELECT gene_id, gene_id || CASE n_exons WHEN 1 THEN '_model.cif' WHEN 2 THEN '_summary_confidences.json' ELSE '_confidences.json' END AS name FROM s4".replace("SELECT gene_id, gene_id ||", "SELECT gene_id AS id, gene_id ||"))
def extract_id(spark, d):
    name = F.concat(F.col("gene_id"), F.when(F.col("n_exons") == 1, "_model.cif").when(F.col("n_exons") == 2, "_summary_confidences.json").otherwise("_confidences.json"))
    return proteins(spark, d).select(S.extract_id(name).alias("id"), name.alias("name"))


_PARENT = "CASE n_exons WHEN 1 THEN gene_id || '_mRNA' WHEN 2 THEN gene_id || '_id003,' || gene_id || '_id001' ELSE gene_id END"


def _parents(spark, d):
    g = F.col("gene_id")
    return proteins(spark, d).withColumn("parent", F.when(F.col("n_exons") == 1, F.concat(g, F.lit("_mRNA"))).when(F.col("n_exons") == 2, F.concat(g, F.lit("_id003,"), g, F.lit("_id001"))).otherwise(g))


@query(f"WITH {S4} SELECT {_PARENT} AS parent, gene_id AS gene FROM s4")
def normalize_parent(spark, d):
    return _parents(spark, d).select("parent", S.normalize_parent(F.col("parent")).alias("gene"))


_HEADER = "gene_id || ' ' || gene_name || ' SGDID:S1, Chr ' || chromosome || ' from 1-9, ' || CASE n_exons WHEN 1 THEN 'Verified' WHEN 2 THEN 'Dubious' ELSE 'Other' END || ' ORF'"


def _head():
    return F.concat(F.lit(">"), F.col("gene_id"), F.lit(" "), F.col("gene_name"), F.lit(" SGDID:S1, Chr "), F.col("chromosome"), F.lit(" from 1-9, "), F.when(F.col("n_exons") == 1, "Verified").when(F.col("n_exons") == 2, "Dubious").otherwise("Other"), F.lit(" ORF"))


def _records(spark, d, twice=False):
    """A FASTA record for each protein, its whole sequence in lines of 60 letters; if twice, each after an older record of the same id."""
    p = proteins(spark, d)
    record = F.concat(_head(), F.lit("\n"), F.regexp_replace("sequence", "(.{60})", "$1\n"), F.lit("*\n"))
    if not twice:
        return p.select(record.alias("value"))
    old = F.concat(_head(), F.lit("\nZZZ"), "sequence")
    return p.select(F.explode(F.array(F.struct(F.lit(1).alias("at"), old.alias("value")), F.struct(F.lit(2).alias("at"), record.alias("value")))).alias("r")).select("r.*")


_PROTEIN = f"WITH {S4} SELECT gene_id, gene_name, CASE n_exons WHEN 1 THEN 'Verified' WHEN 2 THEN 'Dubious' ELSE 'Unknown' END AS category, chromosome, sequence, length(sequence)::INTEGER AS length_aa FROM s4"
query(_PROTEIN, "scan_protein_fasta")(lambda spark, d: IN.protein_records(IN.fasta_records(_records(spark, d, True))))
query(f"WITH {S4} SELECT gene_id, gene_name, CASE n_exons WHEN 1 THEN 'Verified' WHEN 2 THEN 'Dubious' ELSE 'Unknown' END AS category, chromosome FROM s4", "parse_header")(lambda spark, d: IN.protein_records(IN.fasta_records(_records(spark, d))).select("gene_id", "gene_name", "category", "chromosome"))
query(_PROTEIN + " WHERE n_exons < 3", "category_filter")(lambda spark, d: T.known_category(IN.protein_records(IN.fasta_records(_records(spark, d)))))


def _fasta(spark, d):
    """The sequences as FASTA files, in lines of 60 letters."""
    path = scratch(spark)
    seq = F.coalesce("seq", F.lit(""))
    sequences(spark, d).select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit(" first > part\n"), F.regexp_replace(seq, "(.{60})", "$1\n"))).write.text(path)
    return path


@query(
    f"""WITH {S1}, l AS (SELECT seq_id::VARCHAR AS seq_id, coalesce(seq, '') AS seq FROM s1), c AS (SELECT *, unnest(range(0, greatest((length(seq) + 2999) // 3000, 1))) AS chunk FROM l)
 SELECT seq_id, 'first > part' AS doc, chunk, substr(seq, chunk * 3000 + 1, 3010) AS part, length(seq) AS length FROM c"""
)
def scan_fasta(spark, d):
    """Chunks of the files' records, each file read in ranges of 128 KB."""
    return scan_fasta_chunks(spark, _fasta(spark, d), 3000, 10, 1 << 17).select("seq_id", "doc", "chunk", "part", "length")


query(f"WITH {S1} SELECT seq_id, seq FROM s1", "scan_transcript_txt")(lambda spark, d: IN.transcript_text(sequences(spark, d).select("seq_id", F.concat(F.regexp_replace("seq", "(.{70})", "$1\n"), F.lit("\n")).alias("value"))))

# Matrices and splice sites

GROUP = f"""{S2}, ch AS (SELECT *, CASE WHEN parent IS NOT DISTINCT FROM lag(parent) OVER (PARTITION BY seqid ORDER BY ord) THEN 0 ELSE 1 END AS changed FROM s2),
 isl AS (SELECT *, sum(changed) OVER (PARTITION BY seqid ORDER BY ord)::BIGINT AS island FROM ch), grp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY seqid, island) AS size FROM isl) WHERE size > 1)"""
INTRON = GROUP + """, intr AS (SELECT * FROM (SELECT seqid, island, ord, parent, strand, "end" AS this_end, lead(start) OVER (PARTITION BY seqid, island ORDER BY ord) AS next_start FROM grp) WHERE next_start IS NOT NULL)"""
SITES = S1 + ", " + INTRON + """, win AS (
 SELECT seqid, island, ord, strand, 'donor' AS site_type, CASE WHEN strand = '+' THEN this_end - 5 ELSE next_start - 11 END AS lo, CASE WHEN strand = '+' THEN this_end + 10 ELSE next_start + 4 END AS hi FROM intr
 UNION ALL SELECT seqid, island, ord, strand, 'acceptor', CASE WHEN strand = '+' THEN next_start - 11 ELSE this_end - 5 END, CASE WHEN strand = '+' THEN next_start + 4 ELSE this_end + 10 END FROM intr),
 sites AS (SELECT seqid, island, ord, strand, site_type, CASE WHEN strand = '+' THEN substr(seq, lo + 1, 15) ELSE reverse(translate(substr(seq, lo + 1, 15), 'ACGT', 'TGCA')) END AS site FROM win JOIN s1 ON seqid = seq_id WHERE lo >= 0 AND hi <= length(seq))"""
PCOUNT = SITES + """, pos AS (SELECT site_type, unnest(range(0, 15)) AS pos, unnest(string_split(site, '')) AS base FROM sites), pn AS (SELECT site_type AS pssm_id, base, pos, count(*)::DOUBLE AS n FROM pos GROUP BY ALL),
 pc AS (SELECT i.pssm_id, b.base, p.pos::INTEGER AS pos, coalesce(n, 0) AS value FROM (SELECT DISTINCT site_type AS pssm_id FROM sites) i, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b, (SELECT unnest(range(0, 15)) AS pos) p LEFT JOIN pn ON pn.pssm_id = i.pssm_id AND pn.base = b.base AND pn.pos = p.pos)"""
PFREQ = PCOUNT + ", pf AS (SELECT pssm_id, base, pos, value / sum(value) OVER (PARTITION BY pssm_id, pos) AS value FROM pc)"


def _grouped(spark, d):
    return J.exon_group(features(spark, d), parts=parts(spark, d))


def _sites(spark, d):
    return J.junctions(J.introns(features(spark, d), parts=parts(spark, d)), sequences(spark, d))


def _models(spark, d):
    return J.splice_models(_sites(spark, d))


@query(f"WITH {GROUP} SELECT seqid, ord, parent, island, size FROM grp")
def exon_group(spark, d):
    return _grouped(spark, d).select("seqid", "ord", "parent", "island", "size")


@query(f"WITH {GROUP} SELECT seqid, ord, parent, island, size FROM (SELECT grp.*, (SELECT max(island) FROM isl WHERE isl.seqid = grp.seqid) AS last FROM grp) WHERE island < last")
def exon_group_compat(spark, d):
    return J.exon_group(features(spark, d), compat=True, parts=parts(spark, d)).select("seqid", "ord", "parent", "island", "size")


@query(f"WITH {GROUP} SELECT seqid, ord, changed FROM ch")
def prev_parent(spark, d):
    return J.carried(features(spark, d), parts=parts(spark, d)).select("seqid", "ord", "changed")


@query(f"WITH {INTRON} SELECT seqid, island, ord, parent, strand, this_end, next_start FROM intr")
def next_exon(spark, d):
    return J.next_exon(_grouped(spark, d), parts=parts(spark, d))


query(
    f"""WITH {S2} SELECT parent, count(*) AS n_exons, min(start) AS first, max("end") AS last, string_agg(start || '-' || "end", ',' ORDER BY ord) AS members FROM s2 GROUP BY parent""",
    "transcript_group",
)(lambda spark, d: J.transcript_group(features(spark, d)).withColumn("members", F.array_join(F.transform("members", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")))
query(f"WITH {S2} SELECT parent, min(start) AS first, max(\"end\") AS last FROM s2 GROUP BY parent", "extent")(lambda spark, d: J.transcript_group(features(spark, d)).select("parent", "first", "last"))
query(f'WITH {S2} SELECT seqid, ord AS place, parent, start, "end" FROM s2', "genes_by_seqid")(lambda spark, d: J.genes_by_seqid(features(spark, d), parts(spark, d)))
query(f"WITH {S2} SELECT type, count(*) AS n FROM s2 GROUP BY type", "feature_count")(lambda spark, d: J.feature_count(features(spark, d)))
query(f"WITH {S2} SELECT ord, seqid FROM s2 ORDER BY seqid, ord LIMIT 50", "limit_exons")(lambda spark, d: J.limit_features(features(spark, d)).select("ord", "seqid"))
query(f"WITH {SITES} SELECT seqid, island, ord, strand, site_type, lo, hi FROM win", "junction_window")(lambda spark, d: J.junction_window(J.introns(features(spark, d), parts=parts(spark, d))).select("seqid", "island", "ord", "strand", "site_type", "lo", "hi"))
query(f"WITH {SITES} SELECT * FROM sites", "join_junction_seq")(lambda spark, d: _sites(spark, d))
query(f"WITH {SITES} SELECT seqid, count(*) AS n_sites FROM sites GROUP BY seqid", "junction_count")(lambda spark, d: J.junction_count(_sites(spark, d)))
query(f"WITH {PCOUNT} SELECT pssm_id, base, pos, value FROM pc", "pssm_count")(lambda spark, d: _models(spark, d))
query(f"WITH {PCOUNT} SELECT pssm_id, base, pos, value FROM pc WHERE pssm_id = 'donor'", "add_junction")(lambda spark, d: _models(spark, d).where("pssm_id = 'donor'"))
query(f"WITH {PCOUNT} SELECT pssm_id, max(s) AS n FROM (SELECT pssm_id, pos, sum(value) AS s FROM pc GROUP BY ALL) GROUP BY pssm_id", "pssm_n")(lambda spark, d: P.pssm_n(_models(spark, d)))
query(f"WITH {PFREQ} SELECT pssm_id, base, pos, round(value, 9) AS value FROM pf", "pssm_frequency")(lambda spark, d: rounded(P.pssm_frequency(_models(spark, d)), "value"))
query(f"WITH {PFREQ} SELECT 'copy' AS pssm_id, base, pos, round(value, 9) AS value FROM pf WHERE pssm_id = 'donor'", "pssm_copy")(lambda spark, d: rounded(P.pssm_copy(P.pssm_frequency(_models(spark, d)).where("pssm_id = 'donor'"), "copy"), "value"))
query(f"WITH {PFREQ} SELECT pssm_id, pos, round(2 + sum(CASE WHEN value > 0 THEN value * log2(value) ELSE 0 END), 9) AS bits FROM pf GROUP BY ALL", "pssm_information")(lambda spark, d: rounded(P.pssm_information(P.pssm_frequency(_models(spark, d))), "bits"))
query(f"WITH {PFREQ} SELECT pssm_id, base, pos, round(value * value / sum(value * value) OVER (PARTITION BY pssm_id, pos), 9) AS value FROM pf", "pssm_sharpen")(lambda spark, d: rounded(P.pssm_sharpen(P.pssm_frequency(_models(spark, d)), 2), "value"))
query(f"WITH {PFREQ} SELECT pssm_id, base, pos, round(value ** 0.5, 9) AS value FROM pf", "power")(lambda spark, d: rounded(P.pssm_sharpen(P.pssm_frequency(_models(spark, d)), 0.5, normalise=False), "value"))
query(f"WITH {PFREQ} SELECT pssm_id, base, pos, round(CASE WHEN value = 0 THEN -10 ELSE log2(value) END, 9) AS value FROM pf", "log2_floor")(lambda spark, d: rounded(P.pssm_log(P.pssm_frequency(_models(spark, d))), "value"))
query(f"WITH {PFREQ} SELECT pssm_id, count_if(value = 0)::BIGINT AS n_zero FROM pf GROUP BY pssm_id", "pssm_zeros")(lambda spark, d: P.pssm_zeros(P.pssm_frequency(_models(spark, d))))
_CELL4 = "(SELECT unnest(['A', 'C', 'G', 'T']) AS base), (SELECT unnest(range(0, 15)) AS pos)"
query(f"SELECT doc_id AS pssm_id, base, pos::INTEGER AS pos, 0.0::DOUBLE AS value FROM documents, {_CELL4}", "pssm_init")(lambda spark, d: P.pssm_init_each(sequences(spark, d).select(F.col("seq_id").alias("pssm_id"))))
query(f"SELECT kind || '-' || parent AS pssm_id, base, pos::INTEGER AS pos, 0.0::DOUBLE AS value FROM (SELECT DISTINCT 'T' || l_orderkey AS parent FROM lineitem WHERE l_quantity > 49), (SELECT unnest(['donor', 'acceptor']) AS kind), {_CELL4}", "splice_init")(
    lambda spark, d: J.splice_init(features(spark, d).where(F.col("end") - F.col("start") + 1 > 49).select("parent").distinct())
)

SCAN = PFREQ + """, w AS (SELECT base, pos, CASE WHEN value = 0 THEN -10 ELSE log2(value) END AS v FROM pf WHERE pssm_id = 'donor'),
 st AS (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 14, 0))) AS start FROM s1), ex AS (SELECT seq_id, start, unnest(range(0, 15)) AS pos, unnest(string_split(substr(seq, start + 1, 15), '')) AS base FROM st),
 sc AS (SELECT seq_id, start, sum(v) AS score FROM ex JOIN w USING (base, pos) GROUP BY ALL)"""


def _weights(spark, d):
    return P.pssm_log(P.pssm_frequency(_models(spark, d).where("pssm_id = 'donor'")))


def _best(scores):
    x = F.col("score")
    s = scores.withColumn("score", F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6)  # rounded as the SQL does, without decimals
    return s.groupBy("seq_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.round(F.sum("score"), 3).alias("total"))


_BEST = f"WITH {SCAN} SELECT seq_id, count(*) AS n, max(round(score, 6)) AS best, round(sum(round(score, 6)), 3) AS total FROM sc GROUP BY seq_id"
query(_BEST, "pssm_scan")(lambda spark, d: _best(P.pssm_scan(sequences(spark, d), _weights(spark, d))))
query(_BEST, "pssm_scan_gather")(lambda spark, d: _best(P.pssm_scan_sql(sequences(spark, d), _weights(spark, d))))
query(f"WITH {SCAN} SELECT seq_id, round(max(2 ** score), 9) AS likelihood FROM sc GROUP BY seq_id", "exp2")(lambda spark, d: rounded(P.pssm_likelihood(sequences(spark, d), _weights(spark, d)), "likelihood"))
query(f"WITH {SCAN} SELECT pos::INTEGER AS pos, base, count(*) AS n, round(max(v), 9) AS weight FROM ex JOIN w USING (base, pos) GROUP BY ALL", "join_base_pssm")(lambda spark, d: rounded(P.base_weights(sequences(spark, d), _weights(spark, d)), "weight"))

# Regions

_REG = f"""{S1}, {S2}, reg AS (SELECT s2.*, greatest(start - 100, 1) AS a, least("end" + 100, length(seq)) AS b, seq FROM s2 JOIN s1 ON seqid = seq_id),
 cut AS (SELECT *, CASE WHEN b >= a THEN substr(seq, a, b - a + 1) ELSE '' END AS piece FROM reg), regions AS (SELECT seqid, ord, CASE WHEN strand = '-' THEN reverse(translate(piece, 'ACGT', 'TGCA')) ELSE piece END AS region, '>' || parent || ' padding=100 padded_loc=[' || (start - 100) || ',' || ("end" + 100) || '] strand=' || strand AS header FROM cut)"""
query(f"WITH {_REG} SELECT seqid, ord, region FROM regions", "join_gene_seq")(lambda spark, d: R.gene_regions(features(spark, d), sequences(spark, d)).select("seqid", "ord", "region"))
query(f"WITH {_REG} SELECT seqid, ord, piece FROM cut", "subsequence")(lambda spark, d: R.pieces(features(spark, d), sequences(spark, d)).select("seqid", "ord", "piece"))
query(f"WITH {_REG} SELECT seqid, ord, header FROM regions", "region_header")(lambda spark, d: R.gene_regions(features(spark, d), sequences(spark, d)).select("seqid", "ord", "header"))
query(f"WITH {_REG} SELECT header || chr(10) || rtrim(regexp_replace(region, '(.{{100}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM regions", "sink_region_fasta")(lambda spark, d: R.region_fasta(R.gene_regions(features(spark, d), sequences(spark, d))))
query(f"WITH {S2} SELECT seqid, ord, start FROM s2 WHERE start - 100 <= 0", "begin_le_zero")(lambda spark, d: R.begin_le_zero(features(spark, d), 100).select("seqid", "ord", "start"))


def _gff(spark, d):
    """The features as lines; every third has the type CDS, the first is a comment."""
    f = features(spark, d).withColumn("type", F.when(F.col("ord") % 3 == 0, "CDS").otherwise(F.col("type")))
    line = F.concat_ws("\t", F.col("seqid").cast("string"), F.lit("src"), F.col("type"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=x;Parent="), "parent", F.lit(";")))
    return f.select("ord", F.when(F.col("ord") == 1, F.concat(F.lit("#"), line)).otherwise(line).alias("value"))


_GFF = f'WITH {S2} SELECT ord, seqid::VARCHAR AS seqid, start, "end", strand, parent FROM s2 WHERE ord > 1'
query(_GFF + " AND ord % 3 <> 0", "scan_gff")(lambda spark, d: IN.gff_features(_gff(spark, d), ["exon"]).select("ord", "seqid", "start", "end", "strand", "parent"))
query(_GFF + " AND ord % 3 = 0", "scan_gff_cds")(lambda spark, d: IN.gff_features(_gff(spark, d), ["CDS"]).select("ord", "seqid", "start", "end", "strand", "parent"))


# Proteins and metrics


def _proteins(spark, d):
    return proteins(spark, d).withColumn("length_bin", S.assign_bin(F.col("length_aa")))


_SAMPLE = f"""{S4}, o AS (SELECT *, md5(gene_id || '-42') AS h, n_exons > 1 AS intron FROM s4b), o1 AS (SELECT *, intron AND row_number() OVER (PARTITION BY category, intron ORDER BY h, gene_id) <= 3 AS is_forced FROM o),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY category, length_bin ORDER BY is_forced DESC, h, gene_id) AS r FROM o1), sam AS (SELECT * FROM o2 WHERE r <= 20 OR is_forced)"""


def _sample(spark, d):
    return T.stratified_sample(_proteins(spark, d))


query(f"WITH {_SAMPLE} SELECT gene_id, category, length_bin, is_forced FROM sam", "stratified_sample")(lambda spark, d: _sample(spark, d).select("gene_id", "category", "length_bin", "is_forced"))
query(f"WITH {_SAMPLE} SELECT category, length_bin, count(*) AS n FROM sam GROUP BY ALL", "rank_in_stratum")(lambda spark, d: _sample(spark, d).groupBy("category", "length_bin").agg(F.count("*").alias("n")))
query(f"WITH {_SAMPLE} SELECT gene_id FROM s4b WHERE gene_id NOT IN (SELECT gene_id FROM sam WHERE is_forced)", "semi_forced")(lambda spark, d: T.not_forced(_proteins(spark, d), _sample(spark, d)).select("gene_id"))
query(f"WITH {S4} SELECT category, length_bin, row_number() OVER (PARTITION BY category, length_bin ORDER BY gene_id) AS place, gene_id FROM s4b", "cat_bin_group")(lambda spark, d: T.strata(_proteins(spark, d)))
_META = f"WITH {_SAMPLE} SELECT gene_id, category, length_aa, n_exons, CASE WHEN n_exons > 1 THEN 'yes' ELSE 'no' END AS has_introns, length_bin, chromosome, gene_name FROM sam"


def _tsv(spark, d):
    path = scratch(spark)
    OUT.sink_sample_tsv(T.sample_metadata(_sample(spark, d)), path)
    return path


_COLUMNS = "gene_id, category, length_aa, n_exons, has_introns, length_bin, chromosome, gene_name"
query(f"WITH {S4}, tsv AS ({_META.removeprefix(f'WITH {S4}, ')}) SELECT concat_ws(chr(9), {_COLUMNS}) AS value FROM tsv UNION ALL SELECT '{_COLUMNS}'.replace(', ', chr(9))".replace(f"WITH {S4}, tsv AS (o AS", f"WITH {S4}, tsv AS (WITH o AS"), "sink_sample_tsv")(
    lambda spark, d: spark.read.text(_tsv(spark, d))
)
query(_META, "scan_metadata_tsv")(lambda spark, d: IN.scan_metadata_tsv(spark, _tsv(spark, d)))
query(f"WITH {S4} SELECT gene_id FROM s4 ORDER BY gene_id", "sort_gene_ids")(lambda spark, d: T.sorted_ids(proteins(spark, d)))


def _cds(spark, d):
    """Coding features: one for each exon of genes with several, none of the others."""
    return _parents(spark, d).where("n_exons > 1").withColumn("exon", F.explode(F.sequence(F.lit(1), F.col("n_exons"))))


query(f"WITH {S4} SELECT gene_id FROM s4 WHERE n_exons > 1", "exon_count_by_gene_ids")(lambda spark, d: T.exon_count_by_gene(_cds(spark, d)).select("gene_id"))
query(f"WITH {S4} SELECT gene_id, n_exons::BIGINT AS n_exons FROM s4 WHERE n_exons > 1", "exon_count_by_gene")(lambda spark, d: T.exon_count_by_gene(_cds(spark, d)))
query(f"WITH {S4} SELECT gene_id, n_exons::BIGINT AS n_exons FROM s4", "join_exon_counts")(lambda spark, d: T.join_exon_counts(proteins(spark, d), T.exon_count_by_gene(_cds(spark, d))).select("gene_id", "n_exons"))
query(
    f"WITH {S4} SELECT gene_id, '{{\"name\":\"' || gene_id || '\",\"modelSeeds\":[1],\"sequences\":[{{\"protein\":{{\"id\":\"A\",\"sequence\":\"' || sequence || '\",\"description\":\"' || category || ' | ' || n_exons || ' exons | ' || length_aa || ' AA | ' || chromosome || '\"}}}}],\"dialect\":\"alphafold3\",\"version\":4}}' AS json FROM s4",
    "json_encode",
)(lambda spark, d: T.predictor_input(proteins(spark, d)))


_PRETTY = r"""'{\n  "name": "' || gene_id || '",\n  "modelSeeds": [\n    1\n  ],\n  "sequences": [\n    {\n      "protein": {\n        "id": "A",\n        "sequence": "' || sequence || '",\n        "description": "' ||
   category || ' | ' || n_exons || ' exons | ' || length_aa || ' AA | ' || chromosome || '"\n      }\n    }\n  ],\n  "dialect": "alphafold3",\n  "version": 4\n}'""".replace("\\n", "\n")


def _json_files(spark, d):
    """{gene_id}.json of each sampled protein, read again."""
    path = scratch(spark)
    OUT.sink_json(T.predictor_text(_sample(spark, d)), path)
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("gene_id"), F.col("value").alias("json"))


query(f"WITH {_SAMPLE} SELECT gene_id, {_PRETTY} AS json FROM sam", "sink_af3_json")(_json_files)

_RES = "res AS (SELECT vec_id::VARCHAR AS gene_id, unnest(range(1, len(embedding) + 1))::INTEGER AS residue_number, unnest(embedding)::DOUBLE AS plddt FROM embeddings)"
query(f"WITH {_RES} SELECT gene_id, residue_number, plddt FROM res", "plddt_per_residue")(lambda spark, d: T.plddt_per_residue(residues(spark, d)))
query(f"WITH {_RES} SELECT gene_id, residue_number, plddt FROM res ORDER BY gene_id, residue_number", "sort_residues")(lambda spark, d: T.plddt_per_residue(residues(spark, d)).orderBy("gene_id", "residue_number"))
query(f"WITH {_RES} SELECT gene_id, round(avg(plddt), 9) AS mean, round(median(plddt), 9) AS median, round(avg((plddt >= 0)::INTEGER), 9) AS share FROM res GROUP BY gene_id", "plddt_stats")(lambda spark, d: rounded(T.plddt_stats(T.plddt_per_residue(residues(spark, d)), 0.0), "mean", "median", "share"))
query(f"WITH {_RES} SELECT gene_id, (residue_number - 1) // 8 AS segment, round(avg(plddt), 9) AS mean FROM res GROUP BY ALL", "segment_means")(lambda spark, d: rounded(T.segment_means(T.plddt_per_residue(residues(spark, d)), 8), "mean"))


def _cif(spark, d):
    """{gene_id}/{gene_id}_model.cif of each protein, and an older one of the same name."""
    path = scratch(spark)
    row = F.concat_ws(" ", F.lit("ATOM"), F.col("atom_ord").cast("string"), F.lit("'C A'"), F.lit("A"), F.col("auth_seq_id").cast("string"), F.col("b_iso").cast("string"))
    head = "data_x\n_entry.id x\n;a text\n;\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.B_iso_or_equiv\n"
    r = residues(spark, d)
    lines = r.select("gene_id", F.col("atom_ord").alias("place"), F.concat(row, F.lit("\n")).alias("value"))
    lines = lines.unionByName(r.select("gene_id").distinct().select("gene_id", F.lit(-1).cast("long").alias("place"), F.lit(head).alias("value")))
    new = lines.select(F.format_string("b/%s/%s_model.cif", "gene_id", "gene_id").alias("path"), "place", "value")
    old = lines.where("place <= 0").select(F.format_string("a/%s/%s_model.cif", "gene_id", "gene_id").alias("path"), "place", "value")
    write_named(new.unionByName(old), path)
    return path


query(f"WITH {_RES} SELECT gene_id, residue_number, round(plddt, 9) AS plddt FROM res", "scan_mmcif")(lambda spark, d: rounded(T.plddt_per_residue(IN.scan_mmcif(spark, _cif(spark, d)).drop("chain")), "plddt"))


def _summaries(spark, d):
    """A summary for each event, the second field in every third; every fifth is cut off."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.to_json(F.struct(F.col("value").alias("ptm"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 2).alias("fraction_disordered")))
    return e.select(F.col("event_id").cast("string").alias("gene_id"), F.when(F.col("event_id") % 5 == 0, F.left(text, F.length(text) - 1)).otherwise(text).alias("value"))


query("SELECT event_id::VARCHAR AS gene_id, value AS ptm, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS fraction_disordered FROM events WHERE event_id % 5 <> 0", "scan_summary_json")(lambda spark, d: IN.summary_fields(_summaries(spark, d)))
query("SELECT event_id::VARCHAR AS gene_id, 'unreadable summary' AS error FROM events WHERE event_id % 5 = 0", "scan_summary_json_errors")(lambda spark, d: IN.summary_errors(_summaries(spark, d)))


def _matrices(spark, d):
    """Each vector, and the vector backwards, as the rows of a matrix."""
    v = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("gene_id"), F.to_json(F.struct(F.array(v, F.reverse(v)).alias("pae"))).alias("value"))


query(
    """WITH m AS (SELECT vec_id::VARCHAR AS gene_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1))::INTEGER AS k FROM embeddings)
 SELECT gene_id, 0 AS row_idx, k AS col, v[k] AS value FROM m UNION ALL SELECT gene_id, 1, k, v[len(v) + 1 - k] FROM m""",
    "scan_pae_json",
)(lambda spark, d: IN.pae_rows(_matrices(spark, d)).select("gene_id", "row_idx", F.posexplode("pae").alias("k", "value")).select("gene_id", "row_idx", (F.col("k") + 1).alias("col"), "value"))
query(f"WITH {S4} SELECT gene_id, category FROM s4 WHERE n_exons > 1", "join_metrics_meta")(lambda spark, d: T.join_metrics_meta(proteins(spark, d).select("gene_id"), proteins(spark, d).where("n_exons > 1").select("gene_id", "category"))[0])
query(f"WITH {S4} SELECT gene_id FROM s4 WHERE n_exons <= 1", "join_metrics_meta_missing")(lambda spark, d: T.join_metrics_meta(proteins(spark, d).select("gene_id"), proteins(spark, d).where("n_exons > 1").select("gene_id", "category"))[1])
query("SELECT DISTINCT vec_id::VARCHAR AS gene_id FROM embeddings WHERE vec_id % 3 <> 1 ORDER BY gene_id", "sort_pids")(lambda spark, d: T.sorted_ids(IN.discovered(_paths(spark, d))))


def _paths(spark, d):
    """Two models of every vector that isn't the second of three, one in a folder that doesn't count, and another file."""
    v = F.col("vec_id").cast("string")
    kinds = F.array(*(F.concat(F.lit("/run/"), a, v, F.lit(b), v, F.lit(c)) for a, b, c in ((F.lit("a/"), "/", "_model.cif"), (F.lit("b/"), "/", "_model.cif"), (F.lit("c/"), "/seed-1_", "/x_model.cif"), (F.lit("d/"), "/", "_confidences.json"))))
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 <> 1").select(F.explode(kinds).alias("path"))


query("SELECT vec_id::VARCHAR AS gene_id, '/run/b/' || vec_id || '/' || vec_id || '_model.cif' AS path FROM embeddings WHERE vec_id % 3 <> 1", "discover_files")(lambda spark, d: IN.discovered(_paths(spark, d)))


def _jobs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 50).cast("string").alias("minute"), (F.col("event_id") % 7 + 1).alias("n"))
    chains = F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda k: F.concat(F.lit("  Chain "), F.char(k + 64), F.lit(": protein ("), (k * 10).cast("string"), F.lit(" residues)\n"))), "")
    at = lambda hour: F.concat(F.lit("Fri Feb 27 "), F.lit(hour), F.lpad("minute", 2, "0"), F.lit(":21 EST 2026\n"))
    return e.select("path", F.concat(F.lit("Job Name:      J"), "path", F.lit("\nChains:\n"), chains, F.lit("Started:       "), at("05:"), F.lit("Finished:      "), at("06:")).alias("value"))


query(
    "SELECT event_id::VARCHAR AS path, 'J' || event_id AS job_name, event_id % 7 + 1 AS n_chains, 5 * (event_id % 7 + 1) * (event_id % 7 + 2) AS residues, 3600 AS seconds, (10 * 60 + event_id % 50) * 60 + 21 AS started FROM events",
    "scan_run_metadata",
)(
    lambda spark, d: IN.run_metadata(_jobs(spark, d)).select(
        "path", "job_name", F.size("chains").cast("long").alias("n_chains"), F.aggregate("chains", F.lit(0).cast("long"), lambda a, c: a + c["residues"]).alias("residues"), (F.unix_timestamp("finished") - F.unix_timestamp("started")).cast("int").alias("seconds"), F.pmod(F.unix_timestamp("started"), F.lit(86400)).alias("started")
    )
)


# The files of each prediction


def _metrics(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("gene_id"), "vec_id")
    summary = e.where("vec_id % 3 = 0").select("gene_id", (F.col("vec_id") / 4).alias("ptm"), F.when(F.col("vec_id") % 2 == 0, 0.5).alias("fraction_disordered"))
    metadata = e.where("vec_id % 5 <> 0").select("gene_id", F.lit("x").alias("category"))
    pae = IN.pae_rows(_matrices(spark, d)).join(e.where("vec_id % 2 = 0").select("gene_id"), "gene_id", "left_semi")
    return T.plddt_per_residue(residues(spark, d)), summary, pae, metadata


_FILES = """e AS (SELECT vec_id, vec_id::VARCHAR AS gene_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, gene_id, v, unnest(range(1, len(v) + 1)) AS k FROM e),
 f AS (SELECT vec_id, gene_id, 'plddt.tsv' AS name, 'residue_number' || chr(9) || 'plddt' || chr(10) || string_agg(k || chr(9) || printf('%.2f', v[k]) || chr(10), '' ORDER BY k) AS value FROM u GROUP BY ALL
 UNION ALL SELECT vec_id, gene_id, 'pae.tsv', string_agg(printf('%.2f', v[k]), chr(9) ORDER BY k) || chr(10) || string_agg(printf('%.2f', v[len(v) + 1 - k]), chr(9) ORDER BY k) || chr(10) FROM u WHERE vec_id % 2 = 0 GROUP BY ALL
 UNION ALL SELECT vec_id, gene_id, 'ptm.tsv', 'ptm' || chr(10) || (vec_id / 4)::DOUBLE || chr(10) FROM e WHERE vec_id % 3 = 0
 UNION ALL SELECT vec_id, gene_id, 'fraction_disordered.tsv', 'fraction_disordered' || chr(10) || CASE WHEN vec_id % 2 = 0 THEN '0.5' ELSE 'NA' END || chr(10) FROM e WHERE vec_id % 3 = 0
 UNION ALL SELECT vec_id, gene_id, 'metadata.tsv', 'gene_id' || chr(9) || 'category' || chr(10) || gene_id || chr(9) || 'x' || chr(10) FROM e)"""


def _metric_files(spark, d):
    path = scratch(spark)
    OUT.sink_metrics_tsv(T.process_protein(*_metrics(spark, d))[0], path)
    text = whole_texts(spark, path)
    parts = F.split("path", "/")
    return text.select(F.element_at(parts, -2).alias("gene_id"), F.element_at(parts, -1).alias("name"), "value")


def _metric_lines(spark, d):
    lines = T.process_protein(*_metrics(spark, d))[0]
    return lines.select("gene_id", "name", "place.part", "place.k", "value")


query(
    f"""WITH {_FILES}, g AS (
 SELECT vec_id, gene_id, 'plddt.tsv' AS name, 0 AS part, 0 AS k, 'residue_number' || chr(9) || 'plddt' || chr(10) AS value FROM e UNION ALL SELECT vec_id, gene_id, 'plddt.tsv', 1, k, k || chr(9) || printf('%.2f', v[k]) || chr(10) FROM u
 UNION ALL SELECT vec_id, gene_id, 'pae.tsv', 1, 0, string_agg(printf('%.2f', v[k]), chr(9) ORDER BY k) || chr(10) FROM u WHERE vec_id % 2 = 0 GROUP BY vec_id, gene_id
 UNION ALL SELECT vec_id, gene_id, 'pae.tsv', 1, 1, string_agg(printf('%.2f', v[len(v) + 1 - k]), chr(9) ORDER BY k) || chr(10) FROM u WHERE vec_id % 2 = 0 GROUP BY vec_id, gene_id
 UNION ALL SELECT vec_id, gene_id, name, 0, 0, value FROM f WHERE name NOT IN ('plddt.tsv', 'pae.tsv'))
 SELECT gene_id, name, part, k::BIGINT AS k, value FROM g WHERE vec_id % 5 <> 0""",
    "process_protein",
)(_metric_lines)
query(f"WITH {_FILES} SELECT gene_id, 'no metadata' AS error FROM e WHERE vec_id % 5 = 0", "process_protein_errors")(lambda spark, d: T.process_protein(*_metrics(spark, d))[1])
query(f"WITH {_FILES} SELECT gene_id, name, value FROM f WHERE vec_id % 5 <> 0", "sink_metrics")(lambda spark, d: _metric_files(spark, d))


# Text round trips


_CELLS = COUNT + ", cell AS (SELECT frame, codon, aa, value, instr('TCAG', codon[1]) AS a, instr('TCAG', codon[2]) AS b, instr('TCAG', codon[3]) AS c FROM t)"
_TABLE = "string_agg({0} || '  ' || CASE WHEN b = 4 THEN chr(10) ELSE '' END, '' ORDER BY a, c, b)"


def _text(spark, d):
    return C.codon_text(_counts(spark, d), decimal=0).select(F.col("frame").cast("string").alias("table_id"), "value")


def _batch(spark, d):
    """The files of the three frames, read again."""
    folder = scratch(spark)
    OUT.sink_codon_batch(_counts(spark, d), f"{folder}/x")
    return IN.scan_codon_table(spark, f"{folder}/*.count.txt").select(F.regexp_extract("table_id", r"_rf(\d)\.", 1).cast("int").alias("frame"), "codon", "value")


query(f"WITH {COUNT} SELECT frame::VARCHAR AS table_id, codon, value FROM t", "scan_codon_table")(lambda spark, d: IN.codon_table_fields(_text(spark, d)))
query(f"WITH {_CELLS} SELECT frame::VARCHAR AS table_id, {_TABLE.format("codon || ':' || printf('%6.0f', value)")} AS value FROM cell GROUP BY frame", "sink_codon_table")(_text)
query(f"WITH {COUNT} SELECT frame, codon, value FROM t", "sink_codon_batch")(_batch)
query(
    f"""WITH {_CELLS} SELECT frame, printf('%.3f', sum(value)) || ' observations' || chr(10)
 || rtrim(string_agg('   ' || codon || ' ' || aa || ' ' || printf('%6.3f', value) || ' ' || CASE WHEN b = 4 AND c = 4 THEN chr(10) || chr(10) WHEN b = 4 THEN chr(10) ELSE '' END, '' ORDER BY a, c, b), ' ' || chr(10)) AS value FROM cell GROUP BY frame""",
    "fmt_codon_table",
)(lambda spark, d: C.codon_listing(_counts(spark, d)).select("frame", "value"))
query(f"WITH {COUNT} SELECT frame, sum(value) AS n FROM t GROUP BY frame", "codon_n")(lambda spark, d: C.codon_n(_counts(spark, d)).select("frame", "n"))


def _described(ids):
    return ids.select("pssm_id", F.col("pssm_id").alias("title"), F.lit("1a").alias("uid"), F.lit("2020-01-01 101010").alias("creation"), F.array(F.lit("A note"), F.lit("  ")).alias("comments"))


def _meta(spark, d):
    return _described(_models(spark, d).select("pssm_id").distinct())


_NOTED = "(2020-02-02 000000) copied from 1a (' || pssm_id || ')"
query(f"WITH {PCOUNT} SELECT DISTINCT pssm_id, '2b' AS uid, 'A note|  |{_NOTED}|(2020-02-02 000000) converted to frequency' AS comments FROM pc", "pssm_meta_frequency")(lambda spark, d: P.meta_frequency(_meta(spark, d), F.lit("2b"), F.lit("2020-02-02 000000")).select("pssm_id", "uid", F.array_join("comments", "|").alias("comments")))


def _kinds(spark):
    """The provenance of both matrices, whether or not there are sites: the matrices aren't made again for it."""
    return _described(spark.createDataFrame([("donor",), ("acceptor",)], "pssm_id string"))


def _pssm_text(spark, d):
    return P.pssm_text(_models(spark, d), P.meta_copy(_kinds(spark), F.lit("2b"), F.lit("2020-02-02 000000")), offset=5)


def _saved(spark, d):
    """donor.dat and acceptor.dat, read again."""
    folder = scratch(spark)
    OUT.sink_splice_models(_models(spark, d), _kinds(spark), folder, precision=5)
    return IN.scan_pssm(spark, f"{folder}/*.dat").select(F.regexp_extract("pssm_id", r"(\w+)\.dat", 1).alias("pssm_id"), "base", "pos", "value", "offset")


query(f"WITH {PCOUNT} SELECT pssm_id, base, pos, value, 5 AS \"offset\" FROM pc", "scan_pssm")(lambda spark, d: IN.pssm_entries(_pssm_text(spark, d)))
query(f"WITH {PCOUNT} SELECT DISTINCT pssm_id, pssm_id AS title, '2b' AS uid, '2020-01-01 101010' AS creation, 'A note|{_NOTED}' AS comments FROM pc", "scan_pssm_meta")(lambda spark, d: IN.pssm_meta(_pssm_text(spark, d)).select("pssm_id", "title", "uid", "creation", F.array_join("comments", "|").alias("comments")))
query(
    f"""WITH {PCOUNT}, pn2 AS (SELECT pssm_id, max(s) AS n FROM (SELECT pssm_id, pos, sum(value) AS s FROM pc GROUP BY ALL) GROUP BY pssm_id), ln AS (SELECT pssm_id, base, chr(9) || base || string_agg(CASE WHEN pos = 5 THEN '      |' ELSE '' END || printf(' %6.3f', value), '' ORDER BY pos) AS line FROM pc GROUP BY pssm_id, base)
 SELECT pssm_id, 'title: ' || pssm_id || chr(10) || 'uid: 2b' || chr(10) || 'creation: 2020-01-01 101010' || chr(10) || 'n: ' || any_value(n) || chr(10) || 'comment' || chr(10) || chr(9) || 'A note' || chr(10) || chr(9) || '{_NOTED}' || chr(10) || 'pssm 4,15' || chr(10) || string_agg(line, chr(10) ORDER BY base) || chr(10) AS value FROM ln JOIN pn2 USING (pssm_id) GROUP BY pssm_id""",
    "sink_pssm",
)(_pssm_text)
query(f"WITH {PFREQ} SELECT pssm_id, base, pos, printf('%.5f', value)::DOUBLE AS value, CASE pssm_id WHEN 'donor' THEN 5 ELSE 10 END AS \"offset\" FROM pf", "sink_splice_models")(_saved)
query("SELECT doc_id, true AS uid_ok, true AS now_ok FROM documents", "uid")(lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.uid().rlike("^[0-9a-f]{8}$").alias("uid_ok"), S.now().rlike(r"^\d{4}-\d\d-\d\d \d{6}$").alias("now_ok")))
query("SELECT event_id, strftime(ts, '%Y-%m-%d %H%M%S') AS at FROM events", "now")(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", S.stamp(F.col("ts")).alias("at")))
_TEXTS = f"""WITH {FREQ} SELECT frame, codon, printf('%.3f', value) AS three, printf('%8.5f', value) AS five, printf('%.0f', value * 1000) AS none FROM f"""
query(_TEXTS, "fixed")(lambda spark, d: C.codon_frequency(_counts(spark, d)).select("frame", "codon", S.fixed(F.col("value"), 3).alias("three"), S.fixed(F.col("value"), 5, 8).alias("five"), S.fixed(F.col("value") * 1000, 0).alias("none")))
