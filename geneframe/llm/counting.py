"""Token counts by compiled transducers: one finds pre-tokens from maps of states that a prefix scan composes, one counts their tokens.

The pre-tokens of byte-level BPE are ('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+). Whether one starts at
a character depends on a state of a few values, so a chunk of text is a map from the state before it to the state after it. All chunks of a
batch are read at once, one character of each at a time; their maps are then composed by a prefix scan, and each chunk's entry state is known.

Inside a pre-token a second transducer reads bytes. Its state is the suffix that may still grow into a token, with the last token of each
prefix that ends in it; a transition carries the change in the number of tokens. States and transitions are compiled when text first needs
them, so the table grows with what occurs, up to a bound, and not with the vocabulary's square.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes, trimmed

#: Characters of a chunk, and text bytes that a worker holds at once (a text without a place to cut is longer).
CHUNK, PART_BYTES = 128, 1 << 20
#: Bytes of pre-tokens that are counted at once; states kept before the table is compiled anew; bytes of a piece of a long pre-token.
GROUP_BYTES, STATES, PIECE = 1 << 17, 1 << 19, 64
LIMIT = 512

# Classes of characters
END, SP, WS, STMD, R, V, E, L, LETTER, NUMBER, APOSTROPHE, OTHER = range(12)
CLASSES = 12
# States: nothing read, in a run of letters, numbers or others, after an apostrophe that starts a pre-token (and r, v or l), after a
# contraction, after one space or other white space, after several that end in one
START, IN_L, IN_N, IN_O, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE, ONE_SP, ONE_WS, MANY_SP, MANY_WS = range(13)
#: White_Space of Unicode (fixed values).
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _fresh(c: int) -> int:
    """The state after a character that starts a pre-token."""
    if c in (STMD, R, V, E, L, LETTER):
        return IN_L
    return {END: START, SP: ONE_SP, WS: ONE_WS, NUMBER: IN_N, APOSTROPHE: QUOTE, OTHER: IN_O}[c]


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """State, class -> next state, whether a pre-token starts at this character, whether one starts at the character before."""
    letter, space = c in (STMD, R, V, E, L, LETTER), c in (SP, WS)
    here = c != END
    if state in (START, DONE):
        return _fresh(c), here, False
    if state == IN_L and letter or state == IN_N and c == NUMBER or state == IN_O and c in (APOSTROPHE, OTHER):
        return state, False, False
    if state == QUOTE:
        if c in (STMD, R, V, L):
            return {STMD: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], False, False
        if c in (APOSTROPHE, OTHER):
            return IN_O, False, False
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (L if state == QUOTE_L else E):
            return DONE, False, False
        return (IN_L, False, True) if letter else (_fresh(c), here, True)  # the letter was no contraction: it starts a run
    if state in (ONE_SP, ONE_WS, MANY_SP, MANY_WS):
        if space:
            return (MANY_SP if c == SP else MANY_WS), False, False
        if c == END:
            return START, False, False
        joined = IN_O if c == APOSTROPHE else _fresh(c)  # a space goes with the run after it
        return {ONE_SP: (joined, False, False), MANY_SP: (joined, False, True), ONE_WS: (_fresh(c), True, False), MANY_WS: (_fresh(c), True, True)}[state]
    return _fresh(c), here, False


@lru_cache(1)
def _pretokenizer() -> tuple[np.ndarray, ...]:
    """Flat tables: next state and marks by (state, class); and the maps of states that texts can make, numbered from the identity, with
    the map after one more class, and the composition of two maps."""
    n = START + 13
    step = [[_step(s, c) for c in range(CLASSES)] for s in range(n)]
    after = np.array([[x[0] for x in row] for row in step], np.uint8)
    marks = np.array([[x[1] + 2 * x[2] for x in row] for row in step], np.uint8)
    maps, number, grown = [tuple(range(n))], {tuple(range(n)): 0}, []
    for m in maps:  # grows while it is read
        row = []
        for c in range(CLASSES):
            to = tuple(int(after[s, c]) for s in m)
            if to not in number:
                number[to] = len(maps)
                maps.append(to)
            row.append(number[to])
        grown.append(row)
    all_maps = np.array(maps, np.uint8)
    composed = np.zeros((len(maps), len(maps)), np.int16)
    for i, m in enumerate(maps):
        composed[i] = [number[tuple(x)] for x in all_maps[:, list(m)].tolist()]
    return after.ravel(), marks.ravel(), all_maps, np.array(grown, np.int16).ravel(), composed.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[SPACES] = WS
    for c, k in {" ": SP, "'": APOSTROPHE, "r": R, "v": V, "e": E, "l": L, "s": STMD, "t": STMD, "m": STMD, "d": STMD}.items():
        kinds[ord(c)] = k
    return kinds


def scan(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pre-token starts at each character. Chunks are columns, read a character of each at a time; first their maps, then, with
    the entry states that the composed maps give, their marks."""
    after, marks, maps, grown, composed = _pretokenizer()
    lanes = -(-len(classes) // chunk)
    by = np.zeros(lanes * chunk, np.uint8)
    by[: len(classes)] = classes
    by = np.ascontiguousarray(by.reshape(lanes, chunk).T)
    m = np.zeros(lanes, np.int64)
    for row in by:
        m = grown[m * CLASSES + row].astype(np.int64)
    hop, size = 1, len(maps)
    while hop < lanes:  # m[i] becomes the map of all chunks up to i
        m[hop:] = composed[m[:-hop] * size + m[hop:]]
        hop *= 2
    state = np.full(lanes, START, np.int64)
    state[1:] = maps[m[:-1], START]
    out = np.zeros_like(by)
    for k, row in enumerate(by):
        at = state * CLASSES + row
        out[k] = marks[at]
        state = after[at].astype(np.int64)
    out = out.T.reshape(-1)[: len(classes)]
    here = (out & 1).astype(bool)
    here[:-1] |= (out[1:] & 2).astype(bool)
    return here


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A byte-level BPE's merges: which tokens there are and which may stand side by side."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        if len(self.parts) != len(merges):
            raise ValueError("two merges make one token")
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.right, self.left = {}, {}
        self.real = set(map(bytes, zip(range(256))))
        for a, b in merges:
            # a token whose own bytes BPE would merge otherwise never comes out
            if a in self.real and b in self.real and not self._crossed(a, b, self.rank[a, b]):
                self.real.add(a + b)
        self.prefixes = {t[:k] for t in self.real for k in range(1, len(t))}

    def _edge(self, t: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's right (1) or left (0) end while it is merged, with the merge that ends it."""
        known = self.right if side else self.left
        out = known.get(t)
        if out is None:
            out, end, x = [], float("inf"), t
            while True:
                out.append((x, end))
                if x not in self.parts:
                    break
                end = self.rank[self.parts[x]]
                x = self.parts[x][side]
            known[t] = out
        return out

    def _crossed(self, a: bytes, b: bytes, before: float = float("inf")) -> bool:
        """Whether a merge over the border of a and b comes first: one whose two parts both stand there at its time. Of equal merges the
        leftmost goes first, so a's own wins and b's own loses."""
        get = self.rank.get
        for x, x_end in self._edge(a, 1):
            for y, y_end in self._edge(b, 0):
                m = get((x, y))
                if m is not None and m < before and m < x_end and m <= y_end:
                    return True
        return False

    def may_follow(self, a: bytes, b: bytes) -> bool:
        out = self.beside.get((a, b))
        if out is None:
            if len(self.beside) >= 1 << 20:
                self.beside.clear()
            out = self.beside[a, b] = not self._crossed(a, b)
        return out


_BYTES = [bytes([b]) for b in range(256)]


class Transducer:
    """Counts the tokens of pre-tokens. A state: the longest suffix of what was read that a longer token starts with, and for each of its
    positions from the end where one may start, the last token of the text up to there (None: nothing read) and how many tokens that text
    has, less the present."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        first = (b"", (None,), (0,))
        self.states, self.number = [first], {first: 0}
        # transitions in a hash table with free places: state * 256 + byte -> next state and tokens
        self.keys, self.to, self.adds, self.filled = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16), 0
        self.shapes: dict[bytes, tuple] = {}
        self.pieces: dict[tuple[int, bytes], tuple[int, int]] = {}

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key in the table and whether it is there; else the place is free."""
        shift = np.uint64(64 - (len(self.keys).bit_length() - 1))
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        got = self.keys[at]
        there = got == keys
        if not there.all():
            left = np.flatnonzero(~there & (got >= 0))
            while len(left):
                at[left] = (at[left] + 1) & (len(self.keys) - 1)
                got = self.keys[at[left]]
                there[left] = got == keys[left]
                left = left[(got >= 0) & (got != keys[left])]
        return at, there

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        """New transitions, a few at a time as two keys may want one place."""
        if (self.filled + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            keys, to, adds = (np.concatenate(x) for x in ((self.keys[old], keys), (self.to[old], to), (self.adds[old], adds)))
            size = 1 << (len(keys) * 6).bit_length()
            self.keys, self.to, self.adds, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16), 0
        self.filled += len(keys)
        while len(keys):
            at, _ = self._places(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.to[at[first]], self.adds[at[first]] = keys[first], to[first], adds[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, adds = keys[rest], to[rest], adds[rest]

    def _shape(self, x: bytes) -> tuple:
        """Of what can be seen of a text: the tokens that it may end with, longest first; the lengths of its ends that a longer token
        starts with; the longest of these ends."""
        got = self.shapes.get(x)
        if got is None:
            tokens = [(len(x) - k, x[k:]) for k in range(len(x)) if x[k:] in self.merges.real]
            grows = [k for k in range(1, len(x) + 1) if x[-k:] in self.merges.prefixes]
            keep = grows[-1] if grows else 0
            got = self.shapes[x] = (tokens, grows, keep, x[len(x) - keep :])
        return got

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The state after one more byte, and how many tokens that adds."""
        suffix, last, counts = self.states[state]
        tokens, grows, keep, seen = self._shape(suffix + _BYTES[byte])
        may = self.merges.may_follow
        for n, t in tokens:
            if last[n - 1] is None or may(last[n - 1], t):
                break
        add = counts[n - 1] + 1
        ends, less = [t, *[b""] * keep], [0] * (keep + 1)
        for k in grows:
            ends[k], less[k] = last[k - 1], counts[k - 1] - add
        to = (seen, tuple(ends), tuple(less))
        number = self.number.get(to)
        if number is None:
            number = self.number[to] = len(self.states)
            self.states.append(to)
        return number, add

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """The places of transitions, compiled where they are new."""
        at, there = self._places(keys)
        if not there.all():
            new = np.unique(keys[~there])
            made = np.array([self.compile(x >> 8, x & 255) for x in new.tolist()], np.int64)
            self._put(new, made[:, 0], made[:, 1])
            at, _ = self._places(keys)
        return at

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each data[start:end], longest first: one byte of each at a time."""
        size = ends - starts
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        falls = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # how many are longer than k
        for k, m in enumerate(falls.tolist()):
            at = self._known(state[:m] * 256 + data[starts[:m] + k])
            state[:m] = self.to[at]
            total[:m] += self.adds[at]
        return total

    def count_long(self, text: bytes) -> int:
        """Tokens of one long pre-token: the maps of its pieces (state -> state, tokens), each computed once, composed in order."""
        state, total = 0, 0
        for a in range(0, len(text), PIECE):
            if len(self.states) > STATES:  # states are numbered anew
                now = self.states[state]
                self.clear()
                if now not in self.number:
                    self.number[now] = len(self.states)
                    self.states.append(now)
                state = self.number[now]
            piece = text[a : a + PIECE]
            got = self.pieces.get((state, piece))
            if got is None:
                s, n = state, 0
                for b in piece:
                    s, add = self.compile(s, b)
                    n += add
                got = self.pieces[state, piece] = (s, n)
                if len(self.pieces) > STATES:
                    self.pieces.clear()
            state, total = got[0], total + got[1]
        return total


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def compiled(path: str) -> tuple[Transducer, re.Pattern | None]:
    """The transducer of a tokenizer file, and a pattern of the strings that are tokens of their own wherever they stand."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, pre = j["model"], j["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = j.get("added_tokens") or []
    if model["type"] != "BPE" or not plain or j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"{path} is no plain byte-level BPE")
    byte = _byte_of()
    as_bytes = lambda s: bytes(byte[c] for c in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    strings = sorted((a["content"].encode() for a in added), key=len, reverse=True)
    return Transducer(Merges([(as_bytes(a), as_bytes(b)) for a, b in pairs])), re.compile(b"|".join(map(re.escape, strings))) if strings else None


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the parts that texts are read in, and their rows. A longer text is cut before a space that follows a visible ASCII character:
    there every state goes to the same one, so the counts of the parts add up."""
    ends, rows = [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > most:
            lo, cut = a + most, None
            while cut is None and lo < b:  # the next place from here on
                x = data[lo - 1 : min(lo + most, b)]
                hit = np.flatnonzero((x[1:] == 0x20) & (x[:-1] > 0x20) & (x[:-1] < 0x7F))
                cut = lo + int(hit[0]) if len(hit) else None
                lo += most
            if cut is None:
                break
            ends.append(cut)
            rows.append(row)
            a = cut
        ends.append(b)
        rows.append(row)
    return np.array(ends, np.int64), np.array(rows, np.int64)


def counts_of(texts: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text."""
    machine, strings = compiled(path)
    data, offsets = text_bytes(texts)
    out = np.zeros(len(texts), np.int64)
    ends, rows = _parts(data, offsets, PART_BYTES)
    first = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, first[at] + PART_BYTES, "right")))
        lo, hi = int(first[at]), int(ends[stop - 1])
        np.add.at(out, rows[at:stop], _count_parts(machine, strings, data[lo:hi], ends[at:stop] - lo))
        at = stop
    return out


def _count_parts(machine: Transducer, strings: re.Pattern | None, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of tokens of each part data[ends[i-1]:ends[i]]."""
    out = np.zeros(len(ends), np.int64)
    if not len(data):
        return out
    raw = data.tobytes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # a byte place for each character
    kinds = _classes()[np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)]
    for hit in strings.finditer(raw) if strings else ():
        a, b = hit.span()
        part = int(np.searchsorted(ends, a, "right"))
        if b <= ends[part]:
            out[part] += 1
            kinds[np.searchsorted(lead, a) : np.searchsorted(lead, b)] = END
    # an END after each part: where[i] is the place of character i
    part = np.searchsorted(ends, lead, "right")
    where = np.arange(len(lead)) + part
    classes = np.full(len(lead) + len(ends), END, np.uint8)
    classes[where] = kinds
    begins = scan(classes)[where]
    edge = begins | (kinds == END)  # where the pre-token before ends
    edge[1:] |= part[1:] != part[:-1]
    places = np.flatnonzero(edge)
    a, b = lead[places], np.append(lead[places[1:]], len(data))
    own = begins[places]
    a, b, part = a[own], b[own], part[places[own]]
    size = b - a
    long = np.flatnonzero(size > 4 * PIECE)
    for i in long.tolist():
        out[part[i]] += machine.count_long(raw[a[i] : b[i]])
    rest = np.flatnonzero(size <= 4 * PIECE)
    total = np.cumsum(size[rest])
    i = 0
    while i < len(rest):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + GROUP_BYTES, "right")))
        if len(machine.states) > STATES:
            machine.clear()
        few = rest[i:j]
        few = few[np.argsort(-size[few], kind="stable")]
        np.add.at(out, part[few], machine.count(data, a[few], b[few]))
        i = j
    return out


def _count(path: str):
    @trimmed
    def run(batches):
        for batch in batches:
            for few in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(np.diff(text_bytes(few.column("text"))[1]), pa.int64()), pa.array(counts_of(few.column("text"), path), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each document, for a byte-level BPE file of the tokenizers library.

    Strings that the file adds as tokens count as one wherever they stand, as the library's default has it. No shuffle: a text is counted
    where it is read, in parts of about PART_BYTES (a run of visible characters without a space isn't cut), so a lost task is run again.
    A pre-token of any length is read in pieces. The table of transitions is bounded and compiled by each worker; it holds nothing that
    results depend on. Null text: as empty, 0 bytes, 0 tokens. Null or repeated doc_id: a row each. Ties don't arise; other columns aren't
    read. An empty table gives an empty result. The file must be readable on the executors at the same path.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(_count(path or default_path()), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, by the compiled tokenizer; see counted."""
    return counted(table(spark, sf_dir, "documents"))
