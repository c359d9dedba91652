"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, discard, hashes, mix, per_row, shingles, slices, table, text_bytes, trimmed, words, written

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rates are held as whole numbers, so many for one.
RATES, UNIT = ("symbol_rate", "dup_line_rate", "word_length"), 100_000
#: A threshold is the upper quartile plus so many times the spread of the quartiles. A document may exceed it by the noise of its own
#: counts: NOISE standard deviations of a Poisson count.
SPREAD, NOISE = 3, 3
#: A group's fence counts as its documents, its language's beside it as so many more, and so that of all beside the language's.
BORROWED = 50
#: Sketch bins: exact below EXACT, then PER_OCTAVE for each doubling.
EXACT, PER_OCTAVE = 1024, 128


@trimmed
def _measure(batches):
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    golden = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for part in slices(batch, "_text"):
            data, offsets = text_bytes(part.column("_text"))
            n = len(part)
            starts, ends, rows = words(data, offsets)
            count = lambda r, n=n: np.bincount(r, minlength=n).astype(np.int64)
            row_of = lambda at, o=offsets: np.searchsorted(o, at, "right") - 1
            chars = per_row(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)  # bytes that begin a code point of a word
            # lines: cut at \n and at the ends of rows
            breaks = np.flatnonzero(data == 10)
            line_starts = np.sort(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
            line_rows = row_of(np.minimum(line_starts, max(len(data) - 1, 0))) if len(data) else np.zeros(0, int)
            line_ends = np.concatenate((line_starts[1:], [len(data)])) if len(line_starts) else line_starts
            line_ends = np.where((line_ends > line_starts) & (line_ends - 1 < len(data)) & (data[np.maximum(line_ends - 1, 0)] == 10), line_ends - 1, line_ends) if len(data) else line_ends
            has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
            line_starts, line_ends, line_rows = line_starts[has], line_ends[has], line_rows[has]
            key = mix(hashes(data, line_starts, line_ends) + line_rows.astype(np.uint64) * golden)
            order = np.argsort(key, kind="stable")
            again = order[1:][key[order][1:] == key[order][:-1]]
            # words in windows of five that occur twice
            gram, at = shingles(hashes(data, starts, ends), rows)
            key = mix(gram + rows[at].astype(np.uint64) * golden)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, at[twice], 1)
            np.add.at(edge, at[twice] + 5, -1)
            covered = np.cumsum(edge)[:-1] > 0
            found = (count(rows), chars, per_row(symbol[data], offsets), count(line_rows), count(line_rows[again]), count(rows[covered]))
            yield pa.RecordBatch.from_arrays([part.column("_row"), *(pa.array(x) for x in found)], names=["_row", *MEASURES])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, the six measures of the whole text): _row is a struct of all columns of docs, so no name can clash.

    Null and empty text: all zero. A text of one line has no duplicate line; a text under five words has no repeated word. Texts of any
    length: words and lines are hashed in chunks, what stays is one number for each word.
    """
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("_text"))
    return inner.mapInArrow(_measure, f"_row {inner.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def rates() -> dict[str, Column]:
    """Symbols a word and duplicate lines a line, smoothed by half a count, so that texts without any differ by what their length can tell
    (Jeffreys' estimate); characters a word. UNIT is one."""
    smooth = lambda a, b: F.floor(F.lit(float(UNIT)) * (2 * F.col(a) + 1) / (2 * (F.col(b) + 1)))
    return {"symbol_rate": smooth("n_symbols", "n_words"), "dup_line_rate": smooth("n_dup_lines", "n_lines"), "word_length": F.floor(F.lit(float(UNIT)) * F.col("word_chars") / F.col("n_words"))}


#: Rate -> the count that is held against it, and what it is a rate of.
COUNTS = {"symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def within(rate: str) -> Column:
    """Whether the document's count is at most what the threshold lets it expect, and the noise of such a count."""
    count, of = COUNTS[rate]
    expected = F.col(f"{rate}_most") * F.col(of) / float(UNIT)
    return F.col(count) <= expected + NOISE * F.sqrt(expected + 1)


def sketch(m: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): a log-histogram quantile sketch of the rows of m (lang, source, measures) that pass the base rules.

    Two sketches merge by adding n; a bin is within 1/PER_OCTAVE octave.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), c.cast("long").alias("v")) for k, c in rates().items()))).alias("x")
    binned = F.when(F.col("x.v") < EXACT, F.col("x.v")).otherwise(EXACT + F.floor(PER_OCTAVE * F.log2(F.col("x.v") / EXACT))).cast("long")
    return m.where(~base_failed()).select("lang", "source", pairs).select("lang", "source", "x.rate", binned.alias("bin")).groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n"))


def fences(s: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, rate, name, name_rows) from sketches merged by those columns: upper quartile + SPREAD x (upper - lower quartile), documents."""
    s = s.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "rate")
    s = s.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    value = F.when(F.col("bin") < EXACT, F.col("bin").cast("double")).otherwise(EXACT * F.pow(F.lit(2.0), (F.col("bin") - EXACT) / PER_OCTAVE))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    q = s.groupBy(*by, "rate").agg(quartile(0.25).alias("low"), quartile(0.75).alias("high"), F.max("total").alias(f"{name}_rows"))
    return q.select(*by, "rate", F.round(F.col("high") + SPREAD * (F.col("high") - F.col("low")), 6).alias(name), f"{name}_rows")


def thresholds(s: DataFrame) -> DataFrame:
    """(lang, source, <rate>_most ...) from a sketch: the fences of language and source, drawn to the language's, which is drawn to that of
    all, each with the weight of BORROWED documents: so a small group leans on others and a large one on itself, without a switch. Means are
    geometric (of fence + 1), as fences of different groups differ by factors. A null language or source is a value of its own."""
    own = fences(s, ["lang", "source"], "own")
    of_lang = fences(s, ["lang"], "wide").select(F.col("lang").alias("l"), F.col("rate").alias("r"), "wide", "wide_rows")
    of_all = fences(s, [], "whole").select(F.col("rate").alias("k"), "whole")
    t = own.join(of_lang, F.col("l").eqNullSafe(F.col("lang")) & (F.col("r") == F.col("rate"))).join(of_all, F.col("k") == F.col("rate"))
    mean = lambda n, x, y: (n * x + BORROWED * y) / (n + BORROWED)
    log = lambda c: F.log(F.col(c) + 1)
    t = t.withColumn("near", mean(F.col("wide_rows"), log("wide"), log("whole"))).withColumn("most", F.round(F.exp(mean(F.col("own_rows"), log("own"), F.col("near"))) - 1, 6))
    return t.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == k, F.col("most"))).alias(f"{k}_most") for k in RATES))


def _judged(docs: DataFrame, text: str) -> DataFrame:
    """_row, measures, thresholds, base_failed and kept of each row; the texts are measured once."""
    m = written(measured(docs, text))
    grouped = m.select(F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"), *MEASURES)
    s = written(sketch(grouped))  # a few thousand rows for each language and source
    t = written(thresholds(s)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(f"{k}_most" for k in RATES))
    discard(s)
    m = m.join(t, F.col("_row.lang").eqNullSafe(F.col("_lang")) & F.col("_row.source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    good = F.lit(True)
    for k in RATES:
        good = good & F.coalesce(within(k), F.lit(False))
    return m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & good)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but text, the measures, the thresholds, base_failed and kept; a column of docs that is named like one of these
    gives way to it.

    The verdict: no count exceeds what the thresholds of the row's language and source let it expect. They come from the quartiles of all
    rows that pass the base rules, without fixed limits; where no row of a group does, they are null (and no row of it is kept). Ties:
    equal rows get equal verdicts, repeated rows count as often as they come. Null or empty text: no word, base_failed. An empty table
    stays empty.
    """
    results = [*MEASURES, *(f"{k}_most" for k in RATES), "base_failed", "kept"]
    names = [c for c in docs.columns if c != text and c not in results]
    d = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*names, "lang", "source", text])))
    return _judged(d, text).select(*(F.col(f"_row.`{c}`").alias(c) for c in names), *results)


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep (see judged), with their columns, whatever they are named."""
    return _judged(docs, text).where("kept").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, thresholds and verdict; see judged. Null and empty texts fail the base rules, repeated rows are judged alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judged(docs).select("doc_id", *MEASURES, "base_failed", "kept", *(f"{k}_most" for k in RATES))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
w AS (SELECT r, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g2) GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN l ON d.r = l.r LEFT JOIN w ON d.r = w.r),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS (SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'word_length']) AS rate,
        unnest([floor(100000.0::DOUBLE * (2 * n_symbols + 1) / (2 * (n_words + 1))), floor(100000.0::DOUBLE * (2 * n_dup_lines + 1) / (2 * (n_lines + 1))), floor(100000.0::DOUBLE * word_chars / n_words)]) AS v FROM v WHERE NOT base_failed),
b AS (SELECT lang, source, rate, CASE WHEN v < 1024 THEN v ELSE 1024 + floor(128 * log2(v / 1024)) END AS bin, count(*) AS n FROM x GROUP BY ALL),
h AS (SELECT 'own' AS level, lang, source, rate, bin, n FROM b UNION ALL SELECT 'wide', lang, NULL, rate, bin, sum(n) FROM b GROUP BY ALL UNION ALL SELECT 'whole', NULL, NULL, rate, bin, sum(n) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
        CASE WHEN bin < 1024 THEN bin ELSE 1024 * pow(2.0, (bin - 1024) / 128) END AS value FROM h),
q AS (SELECT level, lang, source, rate, max(total) AS n, min(CASE WHEN upto >= 0.25 * total THEN value END) AS low, min(CASE WHEN upto >= 0.75 * total THEN value END) AS high FROM c GROUP BY ALL),
f AS (SELECT *, round(high + 3 * (high - low), 6) AS fence FROM q),
t AS (SELECT o.lang, o.source, o.rate, round(exp((o.n::DOUBLE * ln(o.fence + 1) + 50 * ((w.n::DOUBLE * ln(w.fence + 1) + 50 * ln(a.fence + 1)) / (w.n::DOUBLE + 50))) / (o.n::DOUBLE + 50)) - 1, 6) AS most FROM f o
        JOIN f w ON w.level = 'wide' AND w.lang IS NOT DISTINCT FROM o.lang AND w.rate = o.rate JOIN f a ON a.level = 'whole' AND a.rate = o.rate WHERE o.level = 'own'),
p AS (SELECT lang, source, max(CASE WHEN rate = 'symbol_rate' THEN most END)::DOUBLE AS symbol_rate_most, max(CASE WHEN rate = 'dup_line_rate' THEN most END)::DOUBLE AS dup_line_rate_most,
        max(CASE WHEN rate = 'word_length' THEN most END)::DOUBLE AS word_length_most FROM t GROUP BY ALL),
e AS (SELECT v.*, symbol_rate_most, dup_line_rate_most, word_length_most, symbol_rate_most * n_words / 100000.0::DOUBLE AS es, dup_line_rate_most * n_lines / 100000.0::DOUBLE AS el, word_length_most * n_words / 100000.0::DOUBLE AS ew
      FROM v LEFT JOIN p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_symbols <= es + 3 * sqrt(es + 1) AND n_dup_lines <= el + 3 * sqrt(el + 1) AND word_chars <= ew + 3 * sqrt(ew + 1), false) AS kept,
  symbol_rate_most, dup_line_rate_most, word_length_most
FROM e
"""
