"""Codon tables in long form: table_id, frame, codon, value. All operators are lazy."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import codon_split, fixed
from .chunks import CHUNK, chunked

BASES = "TCAG"
#: Amino acids of the standard code, codons in the order of BASES, first letter slowest (NCBI translation table 1).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
KEYS = ["table_id", "frame"]


def genetic_code(spark: SparkSession) -> DataFrame:
    """codon, aa, family_size: 64 rows."""
    pairs = list(zip(map("".join, product(BASES, repeat=3)), AMINO, strict=True))
    rows = ",".join(f"('{c}','{a}',{AMINO.count(a)})" for c, a in pairs)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(codon, aa, family_size)")


def codon_init(spark: SparkSession, table_id: str = "table", frames=(0,), value: float = 0.0) -> DataFrame:
    """A table with one value for all codons."""
    return genetic_code(spark).select(F.lit(table_id).alias("table_id"), F.explode(F.array(*map(F.lit, frames))).alias("frame"), "codon", F.lit(float(value)).alias("value"))


def codon_init_each(ids: DataFrame, frames=(0,), value: float = 0.0) -> DataFrame:
    """The same for each table_id of ids."""
    cells = codon_init(ids.sparkSession, "", frames, value).drop("table_id").agg(F.collect_list(F.struct("frame", "codon", "value")).alias("cells"))  # 64 a frame
    return ids.select("table_id", cells.scalar().alias("cells")).select("table_id", F.inline("cells"))


def _phases(frames: tuple[int, ...], size: int):
    """Chunks -> one row a frame and codon for each task: codons counted by number at every place, sorted by the place's phase."""
    code = np.full(256, 64)
    for i, c in enumerate(BASES):
        code[ord(c)] = code[ord(c.lower())] = i

    def run(batches):
        total = np.zeros(3 * 65, np.int64)
        for batch in batches:
            for a in range(0, len(batch), 64):
                texts = [(x or "").encode("latin-1", "replace") for x in batch.column("part").slice(a, 64).to_pylist()]
                length = np.array([len(x) for x in texts])
                at = code[np.frombuffer(b"".join(texts), np.uint8)]
                if len(at) < 3:
                    continue
                place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
                left = np.repeat(length, length) - place
                codon = np.minimum(16 * at[:-2] + 4 * at[1:-1] + at[2:], 64)
                codon[(at[:-2] > 3) | (at[1:-1] > 3) | (at[2:] > 3)] = 64
                own = (left[:-2] >= 3) & (place[:-2] < size)  # whole, and not the next chunk's
                total += np.bincount((place[:-2] % 3 * 65 + codon)[own], minlength=3 * 65)
        names = ["".join(c) for c in product(BASES, repeat=3)]
        rows = [(f, c, int(total[f * 65 + i])) for f in frames for i, c in enumerate(names) if total[f * 65 + i]]
        frame, codon, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(frame, pa.int32()), pa.array(codon, pa.string()), pa.array(n, pa.int64())], names=["frame", "codon", "n"])

    return run


def codon_count(sequences: DataFrame, frames=(0, 1, 2), table_id: str = "table") -> DataFrame:
    """Counts over all sequences (seq_id, seq), dense over 64 codons and the frames (of 0, 1, 2). Codons with other letters are left out.

    Sequences are read in chunks that overlap by two letters and start in phase; a task adds up a vector of 64 counts for each frame, so no
    codon becomes a row and one shuffle takes at most 192 rows of each task.
    """
    return codon_count_chunks(chunked(sequences, CHUNK, 2), frames, table_id)


def codon_count_chunks(chunks: DataFrame, frames=(0, 1, 2), table_id: str = "table", size: int = CHUNK) -> DataFrame:
    """codon_count of chunks (part) of that size, a multiple of three, with an overlap of two letters."""
    if not set(frames) <= {0, 1, 2}:
        raise ValueError("a frame is 0, 1 or 2")
    counts = chunks.select("part").mapInArrow(_phases(tuple(frames), size), "frame int, codon string, n long").groupBy("frame", "codon").agg(F.sum("n").cast("double").alias("n"))
    dense = codon_init(chunks.sparkSession, table_id, frames)
    return dense.join(counts, ["frame", "codon"], "left").select("table_id", "frame", "codon", F.coalesce("n", F.lit(0.0)).alias("value"))


def sequence_count(sequences: DataFrame) -> DataFrame:
    """n sequences and their bases."""
    return sequences.agg(F.count("*").alias("n"), F.sum(F.length("seq").cast("long")).alias("bases"))


def family_total(table: DataFrame) -> DataFrame:
    """frame, aa, total of the codons of an amino acid."""
    return with_amino(table).groupBy("frame", "aa").agg(F.sum("value").alias("total"))


def codon_n(table: DataFrame) -> DataFrame:
    return table.groupBy(*KEYS).agg(F.sum("value").alias("n"))


def codon_frequency(table: DataFrame) -> DataFrame:
    return table.withColumn("value", F.try_divide("value", F.sum("value").over(W.partitionBy(*KEYS))))


def codon_pseudocount(table: DataFrame, prior: float = 1.0) -> DataFrame:
    return codon_add_scalar(table, prior)


def codon_add_scalar(table: DataFrame, x: float) -> DataFrame:
    return table.withColumn("value", F.col("value") + F.lit(float(x)))


def codon_div_scalar(table: DataFrame, x: float) -> DataFrame:
    return table.withColumn("value", F.col("value") / F.lit(float(x)))


def _with(a: DataFrame, b: DataFrame, by, how) -> DataFrame:
    other = b.select(*by, "codon", F.col("value").alias("other"))
    return a.join(other, [*by, "codon"]).withColumn("value", how(F.col("value"), F.col("other"))).select(*KEYS, "codon", "value")


def codon_add_table(a: DataFrame, b: DataFrame, by=tuple(KEYS)) -> DataFrame:
    """a + b: each table of a with that of b of the same identifier and frame; by=("frame",) or () for a b that holds one table for all."""
    return _with(a, b, by, lambda x, y: x + y)


def codon_div_table(a: DataFrame, b: DataFrame, strict: bool = False, by=tuple(KEYS)) -> DataFrame:
    """a / b, as codon_add_table; division by zero gives null, or with strict=True an error."""
    return _with(a, b, by, (lambda x, y: x / y) if strict else F.try_divide)


def with_amino(table: DataFrame) -> DataFrame:
    return table.join(F.broadcast(genetic_code(table.sparkSession).select("codon", "aa")), "codon")  # 64 rows


def codon_family(table: DataFrame) -> DataFrame:
    """Each codon with the total of the codons of its amino acid."""
    return with_amino(table).withColumn("value", F.sum("value").over(W.partitionBy(*KEYS, "aa"))).select(*KEYS, "codon", "value")


def codon_preference(table: DataFrame) -> DataFrame:
    """Share of each codon in its family; null where the family is empty."""
    return with_amino(table).withColumn("value", F.try_divide("value", F.sum("value").over(W.partitionBy(*KEYS, "aa")))).select(*KEYS, "codon", "value")


def coding_lr(table: DataFrame) -> DataFrame:
    """codon, lr: share of frame 0 in the three frames' frequencies, normalised to 1. A codon in no frame has none."""
    p = codon_frequency(table)
    at = lambda f: F.sum(F.when(F.col("frame") == f, F.col("value")).otherwise(0.0))
    r = p.groupBy("codon").agg(F.try_divide(at(0), at(0) + at(1) + at(2)).alias("r"))
    return r.select("codon", F.try_divide("r", F.sum("r").over(W.partitionBy())).alias("lr"))


def codon_profile(sequences: DataFrame, lr: DataFrame, size: int = CHUNK) -> DataFrame:
    """seq_id, k, lr of each frame-0 codon; lr has 64 rows. Sequences are read in chunks of whole codons."""
    c = chunked(sequences, size).select("seq_id", "chunk", F.posexplode_outer(codon_split(F.col("part"), 0)).alias("k", "codon")).where("codon is not null")
    return c.join(F.broadcast(lr), "codon", "left").select("seq_id", (F.col("chunk") * (size // 3) + F.col("k")).alias("k"), "lr")


def _means(window: int, size: int):
    code = np.full(256, 64)  # a codon with another letter gets a number past the table
    for i, c in enumerate(BASES):
        code[ord(c)] = code[ord(c.lower())] = i

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                few = batch.slice(a, 256)
                texts = [x.encode("latin-1", "replace") for x in few.column("part").to_pylist()]
                sizes = np.array([len(x) // 3 for x in texts])
                letters = code[np.frombuffer(b"".join(x[: 3 * n] for x, n in zip(texts, sizes, strict=True)), np.uint8)].reshape(-1, 3)
                ratio = np.append(few.column("ratio")[0].values.to_numpy(zero_copy_only=False).astype(float), np.nan)
                v = ratio[np.minimum(letters @ np.array([16, 4, 1]), 64)]
                here, v = ~np.isnan(v), np.nan_to_num(v)
                own = np.minimum(np.array([min(len(x), size) // 3 for x in texts]), np.maximum(sizes - window + 1, 0))
                k = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                at = np.repeat(np.cumsum(sizes) - sizes, own) + k
                total, some = np.zeros(len(at)), np.zeros(len(at), bool)
                for j in range(window):
                    total += v[at + j]
                    some |= here[at + j]
                row = np.repeat(np.arange(len(few)), own)
                first = few.column("chunk").to_numpy() * (size // 3)
                length = few.column("length").to_numpy()
                for lo in range(0, len(row), 1 << 18):
                    p = slice(lo, lo + (1 << 18))
                    yield pa.RecordBatch.from_arrays([few.column("seq_id").take(pa.array(row[p])), pa.array(first[row[p]] + k[p]), pa.array(length[row[p]]), pa.array(total[p] / window, mask=~some[p])], names=["seq_id", "k", "length", "mean"])

    return run


def window_average(sequences: DataFrame, lr: DataFrame, window: int = 5, compat: bool = False, size: int = CHUNK) -> DataFrame:
    """seq_id, k, x, mean: mean of `window` codons from k on, x their middle. Sequences under a window give none.

    compat=True stops early: k <= ceil((length - 6 window) / 3), and only for length > 6 window. Sequences are read in chunks that overlap
    by a window less one codon, and the 64 ratios come as one column of the plan, so no codon is shuffled. A window's sum leaves out codons
    without a ratio, and is always added up in order. Runs on Arrow batches: column lambdas took three times as long.
    """
    place = lambda k: F.instr(F.lit(BASES), F.substring("codon", k, 1)) - 1
    by_code = F.array_sort(F.collect_list(F.struct((16 * place(1) + 4 * place(2) + place(3)).alias("i"), "lr")))
    ratio = codon_init(sequences.sparkSession).select("codon").join(lr, "codon", "left").agg(F.transform(by_code, lambda x: x["lr"]).alias("m")).scalar()
    kind = dict(sequences.dtypes)["seq_id"]
    c = chunked(sequences, size, 3 * (window - 1)).where("part is not null").select("seq_id", "chunk", "part", "length", ratio.alias("ratio"))
    p = c.mapInArrow(_means(window, size), f"seq_id {kind}, k long, length long, mean double")
    if compat:
        p = p.where(F.col("length") > 6 * window).where(F.col("k") <= F.ceil((F.col("length") - 6 * window) / 3))
    return p.select("seq_id", "k", (F.col("k") + (window - 1) / 2).alias("x"), "mean")


def _traditional(table: DataFrame, cell) -> DataFrame:
    """table_id, frame, n, t: the cells' texts in the traditional order; the middle letter runs fastest, then the third, then the first."""
    place = lambda k: F.instr(F.lit(BASES), F.substring("codon", k, 1))
    cells = F.array_sort(F.collect_list(F.struct(place(1).alias("a"), place(3).alias("c"), place(2).alias("b"), cell.alias("t"))))  # 64 at most
    return table.groupBy(*KEYS).agg(F.sum("value").alias("n"), F.transform(cells, lambda x: x["t"]).alias("t"))


def codon_text(table: DataFrame, width: int = 6, decimal: int = 3, sep: str = "  ") -> DataFrame:
    """table_id, frame, value: each table as 16 lines of four codons, each with the separator behind it."""
    t = _traditional(table, F.concat("codon", F.lit(":"), fixed(F.col("value"), decimal, width), F.lit(sep)))
    return t.select(*KEYS, F.array_join(F.transform("t", lambda x, i: F.concat(x, F.when(i % 4 == 3, "\n").otherwise(""))), "").alias("value"))


def codon_listing(table: DataFrame) -> DataFrame:
    """table_id, frame, value: the number of observations, then lines of four codons with their amino acids, an empty line between first
    letters; no white space at the end."""
    t = _traditional(with_amino(table), F.concat(F.lit("   "), "codon", F.lit(" "), "aa", F.lit(" "), fixed(F.col("value"), 3, 6), F.lit(" ")))
    lines = F.transform("t", lambda x, i: F.concat(x, F.when(i % 16 == 15, "\n\n").when(i % 4 == 3, "\n").otherwise("")))
    return t.select(*KEYS, F.concat(fixed(F.col("n"), 3), F.lit(" observations\n"), F.rtrim(F.array_join(lines, ""), F.lit(" \n"))).alias("value"))
