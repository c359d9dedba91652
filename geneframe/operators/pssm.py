"""Position-specific scoring matrices in long form: pssm_id, base, pos, value."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fixed, log2_floor, now, shortest, uid
from .chunks import CHUNK, chunked


def pssm_init(spark: SparkSession, pssm_id: str = "pssm", rows: str = "ACGT", columns: int = 15, value: float = 0.0) -> DataFrame:
    bases = F.explode(F.array(*map(F.lit, rows))).alias("base")
    return spark.range(columns).select(F.lit(pssm_id).alias("pssm_id"), bases, F.col("id").cast("int").alias("pos")).withColumn("value", F.lit(float(value)))


def pssm_init_each(ids: DataFrame, rows: str = "ACGT", columns: int = 15, value: float = 0.0) -> DataFrame:
    """The same for each pssm_id of ids."""
    base = F.explode(F.array(*map(F.lit, rows))).alias("base")
    d = ids.select("pssm_id", base).select("pssm_id", "base", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("pos"))
    return d.withColumn("value", F.lit(float(value)))


def pssm_copy(pssm: DataFrame, pssm_id: str) -> DataFrame:
    return pssm.withColumn("pssm_id", F.lit(pssm_id))


#: Matrices whose counts a task holds before it gives them out.
HELD = 4096


def _codes(rows: str) -> np.ndarray:
    """The row of each byte's letter; the number of rows for those that have none."""
    code = np.full(256, len(rows))
    for i, c in enumerate(rows):
        code[ord(c)] = i
    return code


def _letters(rows: str, columns: int):
    code, width = _codes(rows), len(rows) + 1

    def table(held):
        cells = np.stack(list(held.values()))[:, :, :-1]
        n, per = len(held), columns * (width - 1)
        at = np.tile(np.arange(per), n)
        ids = pa.array(list(held)).take(pa.array(np.repeat(np.arange(n), per)))
        return pa.RecordBatch.from_arrays([ids, pa.array(list(rows)).take(pa.array(at % (width - 1))), pa.array(at // (width - 1), pa.int32()), pa.array(cells.ravel(), pa.int64())], names=["pssm_id", "base", "pos", "n"])

    def run(batches):
        held = {}
        for batch in batches:
            if not len(batch):
                continue
            texts = batch.column("site").to_pylist()
            joined = "".join(texts).encode("latin-1", "replace")
            ids = pa.compute.dictionary_encode(batch.column("pssm_id"), null_encoding="encode")
            names, of = ids.dictionary.to_pylist(), np.asarray(ids.indices)
            at = (of[:, None] * columns + np.arange(columns)) * width + code[np.frombuffer(joined, np.uint8)].reshape(-1, columns)
            counts = np.bincount(at.ravel(), minlength=len(names) * columns * width).reshape(-1, columns, width)
            for name, c in zip(names, counts, strict=True):
                held[name] = held[name] + c if name in held else c
            if len(held) >= HELD:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    return run


def pssm_count(sites: DataFrame, columns: int, rows: str = "ACGT") -> DataFrame:
    """Counts of sites (pssm_id, site) by base and position, dense. Letters outside rows add nothing.

    A task adds up whole matrices, so no letter becomes a row and the sites are read once."""
    kind = dict(sites.dtypes)["pssm_id"]
    site = F.rpad(F.coalesce(F.upper("site"), F.lit("")), columns, " ")
    counts = sites.select("pssm_id", site.alias("site")).mapInArrow(_letters(rows, columns), f"pssm_id {kind}, base string, pos int, n long")
    return counts.groupBy("pssm_id", "base", "pos").agg(F.sum("n").cast("double").alias("value"))


def pssm_n(pssm: DataFrame) -> DataFrame:
    """The largest column sum."""
    return pssm.groupBy("pssm_id", "pos").agg(F.sum("value").alias("s")).groupBy("pssm_id").agg(F.max("s").alias("n"))


def _normalised(pssm: DataFrame) -> DataFrame:
    total = F.sum("value").over(W.partitionBy("pssm_id", "pos"))
    return pssm.withColumn("value", F.coalesce(F.try_divide("value", total), F.lit(float("nan"))))


def pssm_frequency(pssm: DataFrame) -> DataFrame:
    """Divided by column totals; NaN in an empty column."""
    return _normalised(pssm)


def pssm_information(frequencies: DataFrame) -> DataFrame:
    """pssm_id, pos, bits: log2 of the number of rows + sum of p log2 p."""
    p = F.col("value")
    return frequencies.groupBy("pssm_id", "pos").agg((F.log2(F.count("*").cast("double")) + F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("bits"))


def pssm_sharpen(pssm: DataFrame, exponent: float, normalise: bool = True) -> DataFrame:
    out = pssm.withColumn("value", F.pow("value", F.lit(float(exponent))))
    return _normalised(out) if normalise else out


def pssm_log(pssm: DataFrame, floor: float = -10.0) -> DataFrame:
    return pssm.withColumn("value", log2_floor(F.col("value"), floor))


def pssm_zeros(pssm: DataFrame) -> DataFrame:
    """How many entries log2 replaces."""
    return pssm.groupBy("pssm_id").agg(F.count_if(F.col("value") == 0).alias("n_zero"))


def matrix(pssm: DataFrame, rows: str = "ACGT") -> np.ndarray:
    """One matrix as an array: rows x columns numbers come to the driver, by an action of its own. The scans also take the DataFrame."""
    got = pssm.select("base", "pos", "value").collect()
    out = np.zeros((len(rows), 1 + max(r["pos"] for r in got)))
    for r in got:
        out[rows.index(r["base"]), r["pos"]] = r["value"]
    return out


def weights_column(weights: np.ndarray | DataFrame, rows: str = "ACGT") -> Column:
    """A matrix as one array column, row by row. Of a DataFrame it is a scalar subquery: nothing runs while the plan is made."""
    if isinstance(weights, DataFrame):
        cell = F.struct(F.instr(F.lit(rows), F.col("base")).alias("r"), F.col("pos").alias("p"), F.col("value").alias("v"))
        return weights.agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]).alias("w")).scalar()
    return F.array(*(F.lit(float(v)) for v in np.asarray(weights, float).ravel()))


def _windows(batches, rows: str, strict: bool):
    """Chunks, 256 at most, and of each window in them: its chunk's row, its first letter in the chunk, its score."""
    code = _codes(rows)
    for batch in batches:
        parts = batch.column("part")
        for a in range(0, len(batch), 256):
            few = batch.slice(a, 256)
            table = np.asarray(few.column("w")[0].as_py(), float).reshape(len(rows), -1)
            width, table = table.shape[1], np.vstack([table, np.full(table.shape[1], np.nan)])
            texts = [(x or "").encode("latin-1", "replace") for x in parts.slice(a, 256).to_pylist()]
            at = code[np.frombuffer(b"".join(texts), np.uint8)]
            if strict and (at == len(rows)).any():
                raise ValueError("a letter that the matrix lacks")
            lengths = np.array([len(x) for x in texts])
            n = np.maximum(lengths - width + 1, 0)
            # windows of one sequence: their first letters in the joined text
            local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(np.cumsum(lengths) - lengths, n) + local
            # a score at every letter of the joined text, of which those of windows inside a chunk are taken
            score, columns = np.zeros(max(len(at) - width + 1, 0)), np.ascontiguousarray(table.T)
            for j in range(width):
                score += columns[j].take(at[j : j + len(score)])
            yield few, np.repeat(np.arange(len(few)), n), local, score[starts]


def _scan(rows: str, strict: bool, size: int):
    def run(batches):
        for few, row, local, score in _windows(batches, rows, strict):
            first = few.column("chunk").to_numpy() * size
            for lo in range(0, len(row), 1 << 18):
                part = slice(lo, lo + (1 << 18))
                ids = few.column("seq_id").take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(first[row[part]] + local[part]), pa.array(score[part], mask=np.isnan(score[part]))], names=["seq_id", "start", "score"])

    return run


def _likelihoods(rows: str, strict: bool):
    def run(batches):
        for few, row, local, score in _windows(batches, rows, strict):
            first = np.flatnonzero(local == 0)  # a chunk's first window
            if len(first):
                best = np.fmax.reduceat(np.exp2(score), first)
                yield pa.RecordBatch.from_arrays([few.column("seq_id").take(pa.array(row[first])), pa.array(best, mask=np.isnan(best))], names=["seq_id", "likelihood"])

    return run


def pssm_scan(sequences: DataFrame, weights: np.ndarray | DataFrame, rows: str = "ACGT", strict: bool = False, columns: int = 15, size: int = CHUNK) -> DataFrame:
    """seq_id, start, score of every window: the sum of the letters' weights. No shuffle, chunks that overlap by a window less one letter.

    weights: an array, or a matrix (base, pos, value) with that many columns, which is then part of the plan. A window with a letter that
    the matrix lacks has a null score, or with strict=True fails. A sequence under the width gives no row.
    """
    parts, kind = _scored(sequences, weights, rows, columns, size)
    return parts.mapInArrow(_scan(rows, strict, size), f"seq_id {kind}, start long, score double")


def _scored(sequences: DataFrame, weights: np.ndarray | DataFrame, rows: str, columns: int, size: int) -> tuple[DataFrame, str]:
    """Chunks that overlap by a window less one letter, with the matrix; the type of seq_id."""
    columns = columns if isinstance(weights, DataFrame) else np.asarray(weights).shape[1]
    return chunked(sequences, size, columns - 1).select("seq_id", "chunk", "part", weights_column(weights, rows).alias("w")), dict(sequences.dtypes)["seq_id"]


def pssm_likelihood(sequences: DataFrame, weights: np.ndarray | DataFrame, rows: str = "ACGT", strict: bool = False, columns: int = 15, size: int = CHUNK) -> DataFrame:
    """seq_id, likelihood: the largest 2 ** score of a sequence's windows, which are those of pssm_scan.

    All windows are scored and raised where their chunk is; a chunk is one row then, and no window becomes a row. Windows with a null score
    don't count; a sequence that has no others has a null, one under the width no row."""
    parts, kind = _scored(sequences, weights, rows, columns, size)
    return parts.mapInArrow(_likelihoods(rows, strict), f"seq_id {kind}, likelihood double").groupBy("seq_id").agg(F.max("likelihood").alias("likelihood"))


#: Digits of letters' codes, and the bits of a whole number that hold them.
_DIGITS, _BITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", 62


def pssm_scan_sql(sequences: DataFrame, weights: np.ndarray | DataFrame, rows: str = "ACGT", chunk: int = 1024, columns: int = 15) -> DataFrame:
    """The same scores by column expressions only, for at most 31 rows: chunks that overlap by a window, a weight looked up a letter.

    Several windows' letters are one whole number, a few bits a letter, so a window is a shift and no text is cut for it."""
    width = columns if isinstance(weights, DataFrame) else np.asarray(weights).shape[1]
    bits = len(rows).bit_length()
    if bits > 5:
        raise ValueError("31 rows at most")
    most = _BITS // bits
    each = max(1, most - width + 1)  # windows of a number; a matrix wider than a number needs several
    spans = [min(most, each + width - 1 - a) for a in range(0, each + width - 1, most)]
    other = next(c for c in "xyzabcdefghijklmnopqrstuvw?#+;:,<>" if c not in rows)
    digits = F.translate(F.regexp_replace("part", f"[^{re.escape(rows)}]", other), rows + other, _DIGITS[: len(rows) + 1])
    c = chunked(sequences, chunk, width - 1).where(F.length("part") >= width)
    c = c.select("seq_id", (F.col("chunk") * chunk).alias("first"), F.length("part").alias("n"), digits.alias("digits"))
    c = c.select("seq_id", "first", "n", "digits", F.explode(F.sequence(F.lit(0), F.col("n") - width, F.lit(each))).alias("s"))
    number = lambda k, n: F.conv(F.rpad(F.substring(F.col("digits"), F.col("s") + 1 + k * most, F.lit(n)), n, "0"), 1 << bits, 10).cast("long").alias(f"x{k}")
    names = [f"x{k}" for k in range(len(spans))]
    c = c.select("seq_id", (F.col("first") + F.col("s")).alias("first"), F.least(F.lit(each), F.col("n") - width - F.col("s") + 1).alias("n"), *(number(k, n) for k, n in enumerate(spans)))
    c = c.select("seq_id", "first", *names, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    if each > 1:  # the window's letters are the number's last
        c = c.withColumn("x0", F.call_function("shiftright", F.col("x0"), ((each - 1 - F.col("i")) * bits).cast("int")))
        spans = [width]
    c = c.select("seq_id", (F.col("first") + F.col("i")).cast("long").alias("start"), *names, weights_column(weights, rows).alias("w"))
    score = F.lit(0.0)
    for j in range(width):
        k, at = divmod(j, most) if each == 1 else (0, j)
        score = score + F.get("w", (F.shiftright(f"x{k}", bits * (spans[k] - 1 - at)).bitwiseAND(F.lit((1 << bits) - 1)) * width + j).cast("int"))
    return c.select("seq_id", "start", score.alias("score"))


def _positions(rows: str, columns: int):
    code = _codes(rows)
    width, span = len(rows) + 1, np.arange(columns - 1)

    def run(batches):
        n = np.zeros((columns, width), np.int64)
        for batch in batches:
            parts = batch.column("part")
            for a in range(0, len(batch), 256):
                texts = [x.encode("latin-1", "replace") for x in parts.slice(a, 256).to_pylist()]
                at = code[np.frombuffer(b"".join(texts), np.uint8)]
                lengths = np.array([len(x) for x in texts])
                ends = np.cumsum(lengths)
                edge = lambda first: np.bincount((span * width + at[first[:, None] + span]).ravel(), minlength=len(span) * width).reshape(-1, width)  # noqa: E731, B023
                none = np.zeros((1, width), np.int64)
                before = np.concatenate([none, np.cumsum(edge(ends - lengths), axis=0)])
                after = np.concatenate([np.cumsum(edge(ends - len(span))[::-1], axis=0)[::-1], none])
                n += np.bincount(at, minlength=width) - before - after
        pos, base = np.nonzero(n[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array([rows[b] for b in base], pa.string()), pa.array(n[pos, base], pa.int64())], names=["pos", "base", "n"])

    return run


def base_weights(sequences: DataFrame, weights: DataFrame, columns: int = 15, size: int = CHUNK, rows: str = "ACGT") -> DataFrame:
    """pos, base, n, weight: the letters that all windows have at each position, joined with the matrix (base, pos, value).

    A position's letters are the chunk's less those before the first window's and after the last one's, so no letter becomes a row."""
    parts = chunked(sequences, size, columns - 1).where(F.length("part") >= columns).select("part")
    counts = parts.mapInArrow(_positions(rows, columns), "pos int, base string, n long").groupBy("pos", "base").agg(F.sum("n").alias("n"))
    return counts.join(weights.select("pos", "base", F.col("value").alias("weight")), ["pos", "base"])


# Provenance: pssm_id, title, uid, creation, comments


def _noted(meta: DataFrame, note: Column, when: Column) -> DataFrame:
    return meta.withColumn("comments", F.concat("comments", F.array(F.concat(F.lit("("), when, F.lit(") "), note))))


def meta_copy(meta: DataFrame, new_uid: Column | None = None, when: Column | None = None) -> DataFrame:
    """A copy's provenance: an identifier of its own, and a comment that names the matrix it was copied from."""
    m = _noted(meta, F.concat(F.lit("copied from "), "uid", F.lit(" ("), "title", F.lit(")")), now() if when is None else when)
    return m.withColumn("uid", uid() if new_uid is None else new_uid)


def meta_frequency(meta: DataFrame, new_uid: Column | None = None, when: Column | None = None) -> DataFrame:
    """The provenance of a matrix of frequencies: a copy, converted."""
    return _noted(meta_copy(meta, new_uid, when), F.lit("converted to frequency"), now() if when is None else when)


def pssm_text(pssm: DataFrame, meta: DataFrame, offset: int = 0, rows: str = "ACGT", width: int = 6, precision: int = 3) -> DataFrame:
    """pssm_id, value: a matrix as text that scan_pssm reads: tagged lines, comments, rows with a divider before column `offset`."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.concat(F.when((x["pos"] == offset) & F.lit(offset > 0), " " + "|".rjust(width)).otherwise(""), F.concat(F.lit(" "), fixed(x["value"], precision, width))))
    totals = pssm.withColumn("n", F.sum("value").over(W.partitionBy("pssm_id", "pos")))  # one pass: the matrix is made once
    lines = totals.groupBy("pssm_id", "base").agg(F.concat(F.lit("\t"), "base", F.array_join(cells, "")).alias("line"), F.max("pos").alias("last"), F.max("n").alias("n"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.instr(F.lit(rows), F.col("base")).alias("r"), "line"))), lambda x: x["line"])
    m = lines.groupBy("pssm_id").agg(F.array_join(body, "\n").alias("body"), F.concat(F.count("*"), F.lit(","), F.max("last") + 1).alias("shape"), F.max("n").alias("n")).join(meta.drop("n"), "pssm_id")
    notes = F.array_join(F.transform(F.filter("comments", lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("\t"), x, F.lit("\n"))), "")
    head = F.concat(*(x for k in ("title", "uid", "creation") for x in (F.lit(f"{k}: "), F.col(k), F.lit("\n"))), F.lit("n: "), shortest(F.col("n")), F.lit("\ncomment\n"), notes)
    return m.select("pssm_id", F.concat(head, F.lit("pssm "), "shape", F.lit("\n"), "body", F.lit("\n")).alias("value"))
