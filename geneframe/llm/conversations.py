"""Repair of conversations: role and fault sequences as compact strings, each distinct one solved once, edits replayed on the rows.

A row is one letter: its role's kind (s, u, a, o for any other; a capital letter if its text is truncated), or x if it must go. The cheapest
edits depend on these letters alone, so conversations with equal letters share a solution. Letters are gathered in pieces of at most PIECE
rows. A piece is solved for each state in which it can begin and end; a conversation of one piece has its solution at once, a longer one
composes those of its pieces.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written

#: Rows of a piece. Signatures with this share (one in SHARE) of all pieces or more, at most SHARE of them, join by broadcast.
PIECE, SHARE = 128, 1000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: What white space is (fixed values), and what ends a whole sentence.
SPACE = " \t\n\x0b\x0c\r"

# States of the repaired roles: none yet, after the system's, after the user's, after the assistant's
NONE, SYSTEM, USER, ASSISTANT = "e", "s", "u", "a"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after the damage that crc32 of conv_id:turn decides, n how often a row stands there (0: dropped)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]


def _light(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, h) with their number n, whether blank, truncated, or seen at an earlier turn. h: MD5 of the text.

    Equal rows are added up before they are shuffled, so a text that a conversation repeats very often is no hot key."""
    seen = F.rtrim("text", F.lit(SPACE))
    blank = seen == ""
    light = rows.where("n > 0").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), blank.alias("blank"), (~blank & ~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "n")
    light = light.groupBy("conv_id", "turn", "role", "h", "blank", "truncated").agg(F.sum("n").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = light.groupBy("conv_id", "role", "h").agg(F.min(at).alias("first"))
    a, b = light.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.h") == F.col("b.h"))
    earlier = ~F.struct(F.col("a.turn").isNotNull().alias("some"), F.col("a.turn").alias("turn")).eqNullSafe(F.col("b.first"))
    return a.join(b, same).select("a.*", earlier.alias("seen"))


_COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")
_PIECES = "conv_id {c}, part int, place long, sig string, first string, last string, least {t}, most {t}, " + ", ".join(f"{k} long" for k in _COUNTS)


def _gather(schema: pa.Schema, size: int):
    """Rows in order -> pieces: letters, first and last initial, first and last turn, counts. A piece ends with its conversation, its task,
    or after `size` rows; of rows that repeat one, all but the first are duplicates."""

    def run(batches):
        from pyspark import TaskContext

        part, place, out, piece = TaskContext.get().partitionId(), 0, [], None

        def close():
            nonlocal piece, place
            if piece is not None:
                conv, letters, counts, first, last, least, most = piece
                out.append((conv, part, place, "".join(letters), first, last, least, most, *counts))
                place, piece = place + 1, None

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            out.clear()
            return b

        for batch in batches:
            names = ("conv_id", "turn", "role", "blank", "truncated", "seen", "n")
            for conv, turn, role, blank, truncated, seen, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                letter = role[:1]
                kind = {"s": "s", "u": "u", "a": "a"}.get(letter, "o")
                while n:
                    if piece is not None and (piece[0] != conv or len(piece[1]) >= size):
                        close()
                    if piece is None:
                        piece = [conv, [], [0] * len(_COUNTS), letter, None, None, None]
                    letters, counts = piece[1], piece[2]
                    take = min(n, size - len(letters))
                    if turn is not None and turn != piece[6]:
                        counts[1] += 1
                        piece[5] = turn if piece[5] is None else piece[5]
                        piece[6] = turn
                    pairs = ([piece[4] + letter] if letters else []) + [letter * 2] * (take - 1)
                    counts[5] += sum(p not in ("su", "ua", "au") for p in pairs)
                    counts[0] += take
                    if blank:
                        letters.extend("x" * take)
                        counts[2] += take
                    elif seen:
                        letters.extend("x" * take)
                        counts[3] += take
                    else:
                        letters.append(kind.upper() if truncated else kind)
                        counts[4] += truncated
                        letters.extend("x" * (take - 1))
                        counts[3] += take - 1
                    piece[4] = letter
                    n, seen = n - take, True
                if len(out) >= 4096:
                    yield flush()
        close()
        yield flush()

    return run


@lru_cache(1 << 15)
def solve(letters: str, state: str) -> tuple[tuple[str, int, str], ...]:
    """The cheapest edits of letters from a state on, for each state that they can end in: (state, cost, edits' initials), of equal costs
    the least in ASCII. Rows are inserted before a row only; what is missing at a conversation's end is appended by finish().

    Recursion over the suffixes, which are remembered, so signatures that end alike share their solutions.
    """
    if not letters:
        return ((state, 0, ""),)
    best: dict[str, tuple[int, str]] = {}

    def offer(now: str, cost: int, edits: str) -> None:
        for end, more, rest in solve(letters[1:], now):
            new = (cost + more, edits + rest)
            if end not in best or new < best[end]:
                best[end] = new

    kind, late = letters[0].lower(), TRUNCATED if letters[0].isupper() else 0
    now, cost, edits = state, 0, ""
    for _ in range(3):  # no, one or two rows inserted before this one: a third would repeat the state after the first
        offer(now, cost + DELETE, edits + "D")
        need = USER if now != USER else ASSISTANT
        if kind != "x":
            if kind == need or kind == SYSTEM and now == NONE:
                offer(kind, cost + KEEP + late, edits + "K")
            offer(need, cost + REROLE + late, edits + "R")
        now, cost, edits = need, cost + INSERT, edits + "I"
    return tuple((end, c, e) for end, (c, e) in sorted(best.items()))


def finish(state: str) -> tuple[int, str]:
    """What a conversation that stands in this state lacks."""
    n = {NONE: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
    return n * INSERT, "I" * n


def compose(pieces: list[dict[str, list[tuple[str, int, str]]]]) -> tuple[int, list[str]]:
    """The cheapest edits of a conversation from its pieces' solutions: cost, and the edits of each piece (of the last with what is appended).

    Costs to go backwards, then forwards the least edits among the cheapest. Edits of a piece end with a row's, so none begins another.
    """
    to_go = [{s: finish(s)[0] for s in (NONE, SYSTEM, USER, ASSISTANT)}]
    for p in reversed(pieces):
        to_go.append({s: min(c + to_go[-1][e] for e, c, _ in ends) for s, ends in p.items()})
    to_go.reverse()
    state, out = NONE, []
    for i, p in enumerate(pieces):
        edits, state = min((t, e) for e, c, t in p[state] if c + to_go[i + 1][e] == to_go[i][state])
        out.append(edits)
    if out:
        out[-1] += finish(state)[1]
    return to_go[0][NONE], out


def _solved(batches):
    for batch in batches:
        sigs = batch.column("sig").to_pylist()
        text = ["\n".join(f"{s} {e} {c} {t}" for s in (NONE, SYSTEM, USER, ASSISTANT) for e, c, t in solve(x, s)) for x in sigs]
        yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(text, pa.string()), batch.column("n")], names=["sig", "edits", "n"])


def _edits(text: str) -> dict[str, list[tuple[str, int, str]]]:
    out: dict[str, list[tuple[str, int, str]]] = {}
    for line in text.split("\n"):
        s, e, c, t = line.split(" ")
        out.setdefault(s, []).append((e, int(c), t))
    return out


def _replayed(edits: str, rows):
    """Edits and the rows (role, text) that they are about -> the repaired rows, with the edit that made each."""
    state = NONE
    for e in edits:
        need = USER if state != USER else ASSISTANT
        name = "user" if need == USER else "assistant"
        if e == "I":
            yield name, "", e
            state = need
            continue
        role, text = next(rows)
        if e == "K":
            state = role[0]
            yield role, text, e
        elif e == "R":
            state = need
            yield name, text, e


def _conversations(batches):
    """Rows of a task, by conversation: first its pieces, then its texts -> (conv_id, pieces' numbers, edits, cost, repaired rows) one by
    one; the rows are read while they are replayed, so a conversation of any length is never held."""
    stream = (r for b in batches for r in b.to_pylist())
    row = next(stream, None)
    while row is not None:
        conv, pieces = row["conv_id"], []
        while row is not None and row["conv_id"] == conv and row["kind"] == 0:
            pieces.append(row)
            row = next(stream, None)
        cost, audits = compose([_edits(p["edits"]) for p in pieces])

        def texts():
            nonlocal row
            while row is not None and row["conv_id"] == conv and row["kind"] == 1:
                now = row
                row = next(stream, None)
                for _ in range(now["n"]):
                    yield now["role"], now["text"]

        left = texts()
        audit = "".join(audits)
        yield conv, pieces, audit, cost, _replayed(audit, left)
        for _ in left:  # deleted rows at the end
            pass


def _totals(pieces: list[dict]) -> dict[str, int]:
    """A conversation's counts from those of its pieces, in order."""
    out = {k: sum(p[k] for p in pieces) for k in _COUNTS}
    for a, b in zip(pieces, pieces[1:]):
        out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    last, least, most = None, None, None
    for p in pieces:
        if p["least"] is not None:
            out["turns"] -= last is not None and p["least"] == last
            least, most = p["least"] if least is None else least, p["most"]
            last = most
    out["gaps"] = most - least + 1 - out["turns"] if least is not None else 0
    return out


def _digests(schema: pa.Schema):
    @trimmed
    def run(batches):
        out = []

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)
            out.clear()
            return b

        for conv, pieces, audit, cost, rows in _conversations(batches):
            sha, sep = hashlib.sha256(), ""
            for role, text, _ in rows:
                sha.update(f"{sep}{role}:{text}".encode())
                sep = "\n"
            out.append(_totals(pieces) | {"conv_id": conv, "cost": cost, "audit": audit, "repaired_sha256": sha.hexdigest()})
            if len(out) >= 4096:
                yield flush()
        yield flush()

    return run


def _rows(schema: pa.Schema):
    @trimmed
    def run(batches):
        out, size = [], 0
        for conv, _, _, _, rows in _conversations(batches):
            for k, (role, text, edit) in enumerate(rows):
                out.append((conv, k, role, text, edit))
                size += len(text)
                if len(out) >= 4096 or size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _stream(rows: DataFrame, size: int) -> DataFrame:
    """Each conversation's pieces with their solutions, then its texts, in order, all of a conversation in one task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    light = _light(rows)
    ordered = light.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    kind = _PIECES.format(c=kinds["conv_id"], t=kinds["turn"])
    pieces = written(ordered.mapInArrow(_gather(to_arrow_schema(spark.createDataFrame([], kind).schema), size), kind))
    solved = written(pieces.groupBy("sig").agg(F.count("*").alias("n")).mapInArrow(_solved, "sig string, edits string, n long"))
    # a signature with a share of all pieces has at most SHARE peers: those are broadcast, so no join task gets its pieces
    total = solved.agg(F.sum("n")).scalar()
    often = F.broadcast(solved.where(F.col("n") * SHARE >= total).select("sig", F.col("edits").alias("known")))
    seldom = solved.where(F.col("n") * SHARE < total).select("sig", "edits")
    joined = pieces.join(often, "sig", "left")
    joined = joined.where("known is not null").withColumnRenamed("known", "edits").unionByName(joined.where("known is null").drop("known").join(seldom, "sig"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), "text", "n")
    both = joined.drop("sig").withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "part", "place", F.col("turn").asc_nulls_first(), "role", "h")


def audited(conversations: DataFrame, size: int = PIECE, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation (conv_id, turn, role, text)
    after damaged(); or of rows (with n) as they are.

    Rows stand by turn, nulls first; of one turn by role, then by the MD5 of the text. Null role or text: one space. Null conv_id: a
    conversation of its own. Rows that are repeated as a whole stay and count as duplicates. A conversation whose rows are all dropped
    has zeros, an empty audit and the hash of nothing. Texts of any length; other columns aren't read. An empty table gives an empty result.
    Letters are made in tasks that ranges of (conv_id, turn, role, text) deal out, so a long conversation is many tasks; only its SHA-256,
    which must read the repaired texts in order, is one task's, streamed: it holds the solutions of the pieces (16 bytes a row) and the audit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, rows = conversations.sparkSession, damaged(conversations) if rows is None else rows
    kind = f"conv_id {dict(rows.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _stream(rows, size).mapInArrow(_digests(to_arrow_schema(spark.createDataFrame([], kind).schema)), kind)


def repaired(conversations: DataFrame, size: int = PIECE) -> DataFrame:
    """conv_id, place, role, text, edit: the rows after the cheapest repair of a table as it is, in order; edit is K, R or I."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("n"))
    kind = f"conv_id {dict(rows.dtypes)['conv_id']}, place long, role string, text string, edit string"
    return _stream(rows, size).mapInArrow(_rows(to_arrow_schema(conversations.sparkSession.createDataFrame([], kind).schema)), kind)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, audit and repaired digest; see audited."""
    return audited(table(spark, sf_dir, "conversations"))
