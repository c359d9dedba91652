"""Exons, introns and splice sites. Features: ord, seqid, type, start, end, strand, parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import reverse_complement
from .chunks import CHUNK, chunked
from .pssm import pssm_count, pssm_init_each

PRE, POST = 5, 10
#: Features are numbered in blocks of 2 ** BLOCK_BITS places.
BLOCK_BITS = 13


def _keyed(features: DataFrame, bits: int, parts: int | None = None) -> DataFrame:
    """With key: the feature's seqid and block, a range of 2 ** bits places of ord (an integer, or a struct whose last field is one). A block
    has at most that many rows, however many its sequence has, so windows over blocks have no hot task. Dealt to parts tasks, if given: the
    session's number of partitions doesn't grow with the table, and so a task's rows would."""
    kind = features.schema["ord"].dataType
    if isinstance(kind, StructType):
        *names, last = kind.names
        block = F.struct(*(F.col(f"ord.{n}").alias(n) for n in names), F.shiftright(F.col(f"ord.{last}"), bits).alias(last))
    else:
        block = F.shiftright("ord", bits)
    f = features.withColumn("key", F.struct("seqid", block.alias("block")))
    return f.repartition(parts, "key") if parts else f


def _along() -> WindowSpec:
    """A sequence's blocks in order."""
    return W.partitionBy("key.seqid").orderBy("key.block")


def carried(features: DataFrame, bits: int = BLOCK_BITS, size: bool = False, following: bool = False, parts: int | None = None) -> DataFrame:
    """Features with changed (1 where the parent differs from that of the feature before), island (runs of one parent, numbered in each
    seqid) and place (row number in the seqid); ord, unique in a seqid, is the order of the file. With size=True also the island's size and
    last, the number of the seqid's last island; with following=True next: island and start of the next feature.

    Each block is numbered for itself; one row of each block carries its first and last parent, its changes and rows along the sequence,
    and back to it what lies in other blocks: only a block's first and last island can go on there.
    """
    w, head = W.partitionBy("key").orderBy("ord"), F.struct("parent")
    f = _keyed(features, bits, parts).withColumn("place", F.row_number().over(w).cast("long"))
    same = head.eqNullSafe(F.lag(head).over(w))
    f = f.withColumn("changed", F.when((F.col("place") == 1) | same, 0).otherwise(1)).withColumn("island", F.sum("changed").over(w))
    sums = [F.min_by(head, "ord").alias("head"), F.max_by(head, "ord").alias("tail"), F.count("*").alias("n"), F.max("island").alias("changes")]
    if size:
        f = f.withColumn("size", F.count("*").over(W.partitionBy("key", "island")))
        sums += [F.min_by("size", "ord").alias("n_head"), F.max_by("size", "ord").alias("n_tail")]
    if following:
        f = f.withColumn("next", F.lead(F.struct("island", "start")).over(w))
        sums.append(F.min_by("start", "ord").alias("start_head"))
    e = f.groupBy("key").agg(*sums)
    e = e.withColumn("opens", F.when(F.col("head").eqNullSafe(F.lag("tail").over(_along())), 0).otherwise(1))
    so_far = lambda c: F.coalesce(F.sum(c).over(_along().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumns({"rows": so_far("n"), "base": F.sum("opens").over(_along()) + so_far("changes")})
    if following:
        e = e.withColumn("after", F.lead(F.struct(F.col("base").alias("island"), F.col("start_head").alias("start"))).over(_along()))
    if size:
        end = lambda k, n: F.struct((F.col("base") + k).alias("island"), F.col(n).alias("size"))
        ends = F.when(F.col("changes") > 0, F.array(end(F.lit(0), "n_head"), end(F.col("changes"), "n_tail"))).otherwise(F.array(end(F.lit(0), "n_head")))
        kept = [c for c in ("opens", "rows", "base", "changes", "after") if c in e.columns]
        e = e.select("key", *kept, F.explode(ends).alias("x")).withColumn("all", F.sum("x.size").over(W.partitionBy("key.seqid", "x.island")))
        e = e.groupBy("key").agg(*(F.any_value(c).alias(c) for c in kept), F.min_by("all", "x.island").alias("all_head"), F.max_by("all", "x.island").alias("all_tail"))
        e = e.withColumn("last", F.max(F.col("base") + F.col("changes")).over(W.partitionBy("key.seqid")))
    d = f.join(e.select("key", *(c for c in ("opens", "rows", "base", "after", "changes", "all_head", "all_tail", "last") if c in e.columns and (size or c != "changes"))), "key")
    out = {"changed": F.when(F.col("place") == 1, F.col("opens")).otherwise(F.col("changed")), "place": F.col("place") + F.col("rows")}
    if size:
        out["size"] = F.when(F.col("island") == 0, F.col("all_head")).when(F.col("island") == F.col("changes"), F.col("all_tail")).otherwise(F.col("size"))
        out["last"] = F.col("last")
    if following:
        out["next"] = F.coalesce(F.when(F.col("next").isNotNull(), F.struct((F.col("next.island") + F.col("base")).alias("island"), F.col("next.start").alias("start"))), "after")
    return d.select(*features.columns, (F.col("island") + F.col("base")).alias("island"), *(c.alias(n) for n, c in out.items()))


def islands(features: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Runs of consecutive features with one parent, numbered in each seqid; ord is the order of the file in it."""
    return carried(features, bits).drop("changed", "place")


def exon_group(features: DataFrame, compat: bool = False, bits: int = BLOCK_BITS, parts: int | None = None) -> DataFrame:
    """Features of islands with more than one, with size; compat=True leaves out each seqid's last island."""
    f = carried(features, bits, size=True, parts=parts)
    f = f.where("island < last") if compat else f
    return f.where("size > 1").select(*features.columns, "island", "size")


_INTRON = ("seqid", "island", "ord", "parent", "strand")


def introns(features: DataFrame, bits: int = BLOCK_BITS, parts: int | None = None) -> DataFrame:
    """Introns of features as they are: what next_exon makes of exon_group, in one pass."""
    f = carried(features, bits, following=True, parts=parts).where("next.island = island")
    return f.select(*_INTRON, F.col("end").alias("this_end"), F.col("next.start").alias("next_start")).where("next_start is not null")


def next_exon(grouped: DataFrame, bits: int = BLOCK_BITS, parts: int | None = None) -> DataFrame:
    """Introns: an exon's end and the next one's start, in file order. A block's last exon finds its next one at the head of the block after."""
    head = F.struct("island", "start")
    f = _keyed(grouped, bits, parts).withColumn("next", F.lead(head).over(W.partitionBy("key").orderBy("ord")))
    e = f.groupBy("key").agg(F.min_by(head, "ord").alias("head")).select("key", F.lead("head").over(_along()).alias("after"))
    f = f.join(e, "key").withColumn("next", F.coalesce("next", "after")).where("next.island = island")
    return f.select(*_INTRON, F.col("end").alias("this_end"), F.col("next.start").alias("next_start")).where("next_start is not null")


def transcript_group(features: DataFrame) -> DataFrame:
    """All features of a parent, wherever they stand: their number, extent, and members (start, end) in the order of the file.

    A transcript has a bounded number of exons, so its members may be one array."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return features.groupBy("parent").agg(F.count("*").alias("n_exons"), F.min("start").alias("first"), F.max("end").alias("last"), members.alias("members"))


def genes_by_seqid(features: DataFrame, parts: int | None = None) -> DataFrame:
    """seqid, place, parent, start, end: each sequence's features in the order of the file, as rows, so no sequence is one array."""
    return carried(features, parts=parts).select("seqid", "place", "parent", "start", "end")


def feature_count(features: DataFrame) -> DataFrame:
    return features.groupBy("type").agg(F.count("*").alias("n"))


def limit_features(features: DataFrame, n: int = 50) -> DataFrame:
    """The first n features of the file's order (a report on request, not a step of a model)."""
    return features.orderBy("seqid", "ord").limit(n)


def junction_window(introns: DataFrame, pre: int = PRE, post: int = POST) -> DataFrame:
    """introns with site_type and the 0-based bounds of its window, two rows for each intron."""
    plus = F.col("strand") == "+"
    a, b = F.col("this_end"), F.col("next_start")
    donor = F.when(plus, a - pre).otherwise(b - post - 1), F.when(plus, a + post).otherwise(b + pre - 1)
    acceptor = F.when(plus, b - post - 1).otherwise(a - pre), F.when(plus, b + pre - 1).otherwise(a + post)
    pair = F.array(*(F.struct(F.lit(k).alias("site_type"), lo.alias("lo"), hi.alias("hi")) for k, (lo, hi) in (("donor", donor), ("acceptor", acceptor))))
    return introns.select("*", F.explode(pair).alias("w")).select(*introns.columns, "w.site_type", "w.lo", "w.hi")


def junctions(introns: DataFrame, sequences: DataFrame, pre: int = PRE, post: int = POST, size: int = CHUNK) -> DataFrame:
    """Oriented site sequences; windows that leave the sequence are dropped. One join on (seqid, chunk): chunks overlap by a window, so each
    window is whole in the chunk of its first letter."""
    w = junction_window(introns, pre, post).where("lo >= 0").withColumn("chunk", F.floor(F.col("lo") / size))
    w = w.join(chunked(sequences, size, pre + post - 1).withColumnRenamed("seq_id", "seqid"), ["seqid", "chunk"]).where(F.col("hi") <= F.col("length"))
    cut = F.substring(F.col("part"), (F.col("lo") - F.col("chunk") * size + 1).cast("int"), F.lit(pre + post))
    return w.select("seqid", "island", "ord", "strand", "site_type", F.when(F.col("strand") == "+", F.upper(cut)).otherwise(reverse_complement(cut)).alias("site"))


def splice_init(parents: DataFrame, pre: int = PRE, post: int = POST) -> DataFrame:
    """Empty matrices of each parent's donors and acceptors: pssm_id donor-{parent} and acceptor-{parent}, base, pos, value."""
    kinds = F.explode(F.array(F.lit("donor"), F.lit("acceptor"))).alias("kind")
    return pssm_init_each(parents.select("parent", kinds).select(F.concat_ws("-", "kind", "parent").alias("pssm_id")), columns=pre + post)


def splice_models(sites: DataFrame, pre: int = PRE, post: int = POST) -> DataFrame:
    """Count matrices of donors and acceptors."""
    return pssm_count(sites.select(F.col("site_type").alias("pssm_id"), "site"), pre + post)


def junction_count(sites: DataFrame) -> DataFrame:
    return sites.groupBy("seqid").agg(F.count("*").alias("n_sites"))
