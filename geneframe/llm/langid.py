"""Language identification: unigram probabilities of a fixed vocabulary's pieces, summed over all segmentations of each word."""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from functools import lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, slices, table, trimmed, written

#: A language is learned from at most this many documents (whole texts, those of smallest hash), in so many EM rounds.
DOCUMENTS, ROUNDS = 400, 4
#: A run of more letters is summed position by position, with the sums scaled; LOOK positions' pieces are looked up at once.
LONG, LOOK = 40, 1 << 14
#: Distinct words whose likelihoods a task keeps before it starts anew.
CACHE = 500_000
#: Counts that the piece frequencies of all languages add to those of each; the least probability of a piece.
PRIOR, LEAST = 200.0, 1e-7
_START = "▁"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(1)
def _letters() -> re.Pattern:
    """Runs of letters (str.isalpha): word characters but the underscore, decimal digits, and other numerals such as fractions."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal():
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile(r"[^\W\d_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")


def vocabulary(path: str) -> list[str]:
    """The text pieces of a sentencepiece model that lower-case words can hold: letters, of any number, with or without the mark of a word's
    start; and the mark alone."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    return sorted(x for x in found if x == _START or (x == x.lower() and x.removeprefix(_START).isalpha()))


def letters(text: str | None) -> list[str]:
    """The words that are scored: whole runs of letters in lower case, their start marked."""
    return [_START + w for w in _letters().findall(text.lower())] if text else []


class Lattice:
    """Finds the pieces in words. Piece ids: as in the vocabulary; then one for a letter that it lacks; then one for no piece."""

    def __init__(self, pieces: list[str]):
        h = self._hash([np.array([ord(c) for c in p], np.uint64) for p in pieces])
        order = np.argsort(h)
        self.keys, self.ids, self.unknown, self.none = h[order], order.astype(np.int32), len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def _hash(points: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(points), np.uint64)
        for i, p in enumerate(points):
            h = np.zeros(1, np.uint64)
            for c in p:
                h = (h + c) * _MULTIPLIER
                h ^= h >> np.uint64(29)
            out[i] = h[0]
        return out

    def _find(self, h: np.ndarray, single: bool) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], self.unknown if single else self.none)

    def arcs(self, words: list[str]):
        """For each length up to LONG: the words' numbers, and (start, end) -> piece ids of all words of that length."""
        sizes = np.array([len(w) for w in words], np.int64)
        for m in np.unique(sizes[sizes <= LONG]):
            which = np.flatnonzero(sizes == m)
            points = np.array([words[i] for i in which], f"<U{m}").view(np.uint32).reshape(len(which), m).astype(np.uint64)
            arcs = {}
            for i in range(m):
                h = np.zeros(len(which), np.uint64)
                for j in range(i + 1, min(m, i + self.longest) + 1):
                    h = (h + points[:, j - 1]) * _MULTIPLIER
                    h ^= h >> np.uint64(29)
                    ids = self._find(h, j == i + 1)
                    if j == i + 1 or (ids != self.none).any():
                        arcs[i, j] = ids
            yield int(m), which, arcs

    def ending(self, word: str):
        """For each position of a long word: the ids of the pieces that end there, by length; LOOK positions at a time."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        for lo in range(0, len(points), LOOK):
            hi = min(lo + LOOK, len(points))
            ids = np.full((hi - lo, self.longest), self.none)
            first = max(0, lo - self.longest + 1)
            h = np.zeros(hi - first, np.uint64)  # by start
            for size in range(1, min(self.longest, hi - first) + 1):
                h = h[: hi - first - size + 1]
                h = (h + points[first + size - 1 : hi]) * _MULTIPLIER
                h ^= h >> np.uint64(29)
                end = np.arange(first + size - 1, hi)  # the last position of the piece
                ok = end >= lo
                ids[end[ok] - lo, size - 1] = self._find(h[ok], size == 1)
            yield from ids

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations; p has a row for each piece id (that of none is 0) and a column for each language."""
        out = np.zeros((len(words), p.shape[1]))
        for m, which, arcs in self.arcs(words):
            a = np.zeros((m + 1, len(which), p.shape[1]))
            a[0] = 1
            for (i, j), ids in sorted(arcs.items(), key=lambda x: x[0][1]):
                a[j] += a[i] * p[ids]
            out[which] = np.log(a[m])
        for k, w in enumerate(words):
            if len(w) > LONG:
                last, logs = np.zeros((self.longest, p.shape[1])), np.zeros(p.shape[1])  # the sums up to the last positions, nearest first
                last[0] = 1
                for ids in self.ending(w):
                    total = (last * p[ids]).sum(axis=0)
                    logs += np.log(total)
                    last = np.concatenate((np.ones((1, p.shape[1])), last[:-1] / total))
                out[k] = logs
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts under p (one column), forward times backward."""
        out = np.zeros(len(p))
        for w, n in ((words[k], counts[k]) for k in range(len(words)) if len(words[k]) > LONG):
            ends, m = np.stack(list(self.ending(w))), len(w)
            a, b = np.zeros(m + 1), np.zeros(m + 1)  # logs of the sums up to a position and from it
            for j in range(1, m + 1):
                size = np.arange(1, min(self.longest, j) + 1)
                a[j] = a[j - 1] + np.log((np.exp(a[j - size] - a[j - 1]) * p[ends[j - 1, size - 1]]).sum())
            for i in range(m - 1, -1, -1):
                size = np.arange(1, min(self.longest, m - i) + 1)
                b[i] = b[i + 1] + np.log((np.exp(b[i + size] - b[i + 1]) * p[ends[i + size - 1, size - 1]]).sum())
            for size in range(1, min(self.longest, m) + 1):
                i = np.arange(m - size + 1)
                ids = ends[i + size - 1, size - 1]
                out += np.bincount(ids, weights=n * np.exp(a[i] + b[i + size] - a[m]) * p[ids], minlength=len(p))
        for m, which, arcs in self.arcs(words):
            a, b = np.zeros((m + 1, len(which))), np.zeros((m + 1, len(which)))
            a[0] = b[m] = 1
            for (i, j), ids in sorted(arcs.items(), key=lambda x: x[0][1]):
                a[j] += a[i] * p[ids]
            for (i, j), ids in sorted(arcs.items(), key=lambda x: -x[0][0]):
                b[i] += b[j] * p[ids]
            scale = counts[which] / a[m]
            for (i, j), ids in arcs.items():
                out += np.bincount(ids, weights=a[i] * p[ids] * b[j] * scale, minlength=len(p))
        return out


@trimmed
def _count(batches):
    """Texts with their language -> the distinct words of each slice and their counts."""
    for batch in batches:
        for part in slices(batch, "text"):
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                for w in letters(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            kinds = (pa.string(), pa.string(), pa.int64())
            columns = zip(*((*k, n) for k, n in seen.items()), strict=True) if seen else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["lang", "word", "n"])


def _expect(pieces: list[str], p):
    """Words and their counts -> expected counts of pieces under the language's p (uniform in the first round)."""

    @trimmed
    def run(batches):
        lattice, total = Lattice(pieces), {}
        for batch in batches:
            langs, words = np.array(batch.column("lang").to_pylist(), object), batch.column("word").to_pylist()
            counts = batch.column("n").to_numpy().astype(float)
            for lang in dict.fromkeys(langs):
                own = np.flatnonzero(langs == lang)
                c = lattice.expected([words[i] for i in own], counts[own], p.value[lang])
                total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            has = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has), pa.array(c[has])], names=["lang", "piece", "n"])

    return run


class Model:
    def __init__(self, pieces: list[str], rows: list[tuple[str, int, float]]):
        self.pieces, self.langs = pieces, sorted({r[0] for r in rows})
        column = {x: i for i, x in enumerate(self.langs)}
        c = np.zeros((len(pieces) + 2, len(self.langs)))
        for lang, piece, n in rows:
            c[piece, column[lang]] = n
        shared = c / np.maximum(c.sum(axis=0, keepdims=True), 1e-12)
        c = c + PRIOR * shared.mean(axis=1, keepdims=True) if self.langs else c
        self.p = np.maximum(c / np.maximum(c.sum(axis=0, keepdims=True), 1e-12), LEAST)
        self.p[-1] = 0


def _bounds(docs: DataFrame) -> DataFrame:
    """(of, most): the bin of hashes up to which DOCUMENTS documents of a language lie, or all its documents.

    A histogram of 2**20 bins is summed to 2**10 first, and only the boundary's bins are looked at one by one, so a task meets 2**10 rows
    of a language at most, however many documents it has. The result, a row for each language, is written: its size is then known, and
    Spark need not deal all texts out by language.
    """
    bins = written(docs.groupBy("lang", F.shiftright("h", 44).alias("b")).agg(F.count("*").alias("n")))
    coarse = bins.groupBy("lang", F.shiftright("b", 10).alias("c")).agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("before", F.sum("n").over(W.partitionBy("lang").orderBy("c")) - F.col("n")).where(F.col("before") < DOCUMENTS)
    at = written(coarse.groupBy(F.col("lang").alias("of")).agg(F.max("c").alias("c"), F.max("before").alias("before")))
    fine = bins.join(at, (F.col("lang") == F.col("of")) & (F.shiftright("b", 10) == F.col("c")))
    fine = fine.withColumn("before", F.col("before") + F.sum("n").over(W.partitionBy("lang").orderBy("b")) - F.col("n")).where(F.col("before") < DOCUMENTS)
    return written(fine.groupBy("of").agg(F.max("b").alias("most")))


def learned(docs: DataFrame, path: str | None = None) -> Model:
    """docs (doc_id, text, lang) -> a model of the non-null languages, each fitted by EM on DOCUMENTS documents at most.

    Words are counted where the texts are and added up; each round of EM runs over the distinct words in all tasks.
    """
    pieces = vocabulary(path or default_path())
    docs = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    last = _bounds(docs)
    few = docs.join(last, (F.col("lang") == F.col("of")) & (F.shiftright("h", 44) <= F.col("most"))).select("lang", "text", "h")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= DOCUMENTS)
    words = written(few.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p, rows = {}, []
    uniform = np.full(len(pieces) + 2, 1 / (len(pieces) + 1))
    uniform[-1] = 0
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(defaultdict(partial(np.copy, uniform), p))
        found = words.mapInArrow(_expect(pieces, shared), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        rows = sorted(tuple(r) for r in found.collect())  # a row for each language and piece of the vocabulary at most
        for lang, own in groupby(rows, key=lambda r: r[0]):
            c = np.zeros(len(uniform))
            for _, piece, n in own:
                c[piece] = n
            p[lang] = np.maximum(c / c.sum(), LEAST)
            p[lang][-1] = 0
    discard(words)
    return Model(pieces, [r for r in rows if r[2] > 1e-3])


def _score(model):
    @trimmed
    def run(batches):
        m = model.value
        lattice, cache, known = Lattice(m.pieces), {}, [np.zeros((0, len(m.langs)))]
        for batch in batches:
            for part in slices(batch, "text"):
                found = [letters(t) for t in part.column("text").to_pylist()]
                sizes = np.array([len(x) for x in found], np.int64)
                coded = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(cache) > CACHE:  # numbers start at 0 again, so no old row may stay
                    cache, known = {}, [np.zeros((0, len(m.langs)))]
                new = [w for w in words if w not in cache]
                if new:
                    cache |= {w: len(cache) + i for i, w in enumerate(new)}
                    known.append(lattice.forward(new, m.p))
                    if len(known) > 16:
                        known = [np.concatenate(known)]
                flat = np.concatenate(known)
                of_word = flat[[cache[w] for w in words]] if words else flat[:0]
                codes = coded.indices.to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(part)), sizes)
                total = np.stack([np.bincount(rows, weights=of_word[codes, k], minlength=len(part)) for k in range(len(m.langs))], 1) if len(m.langs) else np.zeros((len(part), 0))
                none = (sizes == 0) | (not m.langs)
                best = total.argmax(axis=1) if m.langs else np.zeros(len(part), int)
                share = np.exp(total - total.max(axis=1, keepdims=True)) if m.langs else total
                score = np.where(none, 0.0, 1 / share.sum(axis=1)) if m.langs else np.zeros(len(part))
                lang = ["und" if x else m.langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text).

    Each distinct word is scored once in a task (a cache of bounded size), by the forward sum over all its segmentations, for all
    languages; a text's log-likelihood is the sum over its words, and score the best language's share under equal priors.
    Runs of letters are never cut: long ones are summed with scaled sums, so their length costs time, not exactness. Repeated rows are
    scored alike, other columns are not read, an empty table gives an empty result.
    Null text, or text without a letter, or a model without languages: 'und' with score 0. A tie goes to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(_score(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that aren't held out; see predicted."""
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learned(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
