"""Conversation repair, hard negatives and token counts against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geneframe.llm import conversations, counting, negatives

# Conversation repair

TALK = "conv_id long, turn long, role string, text string, n string, h string"


def damage(rows):
    """Conversations -> rows after damage, in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Best-first search over whole edit sequences: (cost, audit, repaired rows)."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, now, fixed = heapq.heappop(heap)
        if at == len(rows) and now in ("", "a"):
            return cost, audit, fixed
        if (at, now) in done:
            continue
        done.add((at, now))
        follows = lambda r: r == "u" if now in ("s", "", "a") else r == "a"
        for name in ("user", "assistant"):
            if follows(name[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", at, name[0], (*fixed, (name, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, now, fixed))
            if kinds[at] not in ("blank", "duplicate"):
                more = 5 if kinds[at] == "truncated" else 0
                if role[:1] and (follows(role[0]) or role[0] == "s" and now == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*fixed, (role, text))))
                for name in ("user", "assistant"):
                    if follows(name[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, name[0], (*fixed, (name, text))))


def expected(rows):
    out = {}
    for conv, own in damage(rows).items():
        kinds = faults(own)
        turns = [t for t, *_ in own if t is not None]
        cost, audit, fixed = cheapest(own, kinds)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    r = random.Random(5)
    texts = ["Hello there.", "Yes!", "No", "", " \t", None, "What?", "So it goes on ", "é.", "long " * 30000 + "."]
    rows = []
    for conv in [*range(150), None]:
        turn = 0
        for _ in range(r.randrange(1, 9)):
            turn += r.choice([0, 1, 1, 1, 3])
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "urn"])
            rows.append((conv, r.choice([turn, turn, turn, None]), role, r.choice(texts), "x", "y"))
    rows += [(999, k // 2, ("user", "assistant")[k % 2], f"Part {k % 50}{'.' * (k % 7 > 0)}", "x", "y") for k in range(700)]
    rows.append((next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "All dropped.", "x", "y"))
    return rows + rows[:20]


def digests(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_conversations(spark, talk):
    df = spark.createDataFrame(talk, TALK)
    want = expected(talk)
    got = digests(conversations.audited(df))
    assert got == want
    assert any(w[6] == "" and w[5] == 0 for w in want.values()) and {c for w in want.values() for c in w[6]} == set("DKR")  # a row is deleted for less than one is inserted
    for size in (1, 2, 7):  # pieces compose to the same edits
        assert digests(conversations.audited(df.where("conv_id < 60 OR conv_id = 999"), size)) == {c: w for c, w in want.items() if c is not None and (c < 60 or c == 999)}
    assert conversations.audited(df.limit(0)).count() == 0 and conversations.repaired(df.limit(0)).count() == 0


def test_conversations_rows(spark, talk):
    """Repaired rows of a table as it is: legal, and what the digest is made of."""
    df = spark.createDataFrame([r for r in talk if r[0] is not None and r[0] < 40], TALK)
    by = {}
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        by.setdefault(r["conv_id"], []).append(r)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("n"))
    sha = {r["conv_id"]: r["repaired_sha256"] for r in conversations.audited(df, rows=rows).collect()}
    for conv, own in by.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert sha[conv] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest()


def test_solve():
    """Signatures of up to four rows against the search."""
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(5):
        for letters in itertools.product("suaoSUAx", repeat=n):
            rows = [(0, names[c.lower()] if c != "x" else "user", "") for c in letters]
            kinds = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in letters]
            pieces = [{s: list(conversations.solve(p, s)) for s in "esua"} for p in ("".join(letters[:2]), "".join(letters[2:])) if p]
            cost, audits = conversations.compose(pieces)
            assert (cost, "".join(audits)) == cheapest(rows, kinds)[:2], letters


def test_op11_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = digests(conversations.op11_conversations(spark, d))
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == expected(rows) and len(got) == len({r[0] for r in rows})


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, gid string, x int"


def plain(rows):
    own = []
    for k, (i, e, label, *_) in enumerate(rows):
        if label is None or e is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        own.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in e], k))
    out = []
    last = lambda i: (i is None, i or 0)
    for i, label, q, k in own:
        if i is None or i % 50:
            continue
        score = lambda x: sum(a * b for a, b in zip(q, x))
        best = sorted((-score(x), last(j), j) for j, m, x, n in own if m == label and n != k)[:5]
        others = sorted((-score(x), last(j), j) for j, m, x, n in own if m != label)
        for s, _, j in best:
            fit = [(-t, o) for t, _, o in others if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, o, -s, t) for r, (t, o) in enumerate(fit)]
    return sorted(map(str, out))


def mined(df):
    return sorted(map(str, map(tuple, negatives.mined(df).collect())))


def vectors(n, seed, dim=6, spread=0.3):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(4, dim))
    rows = [(i, [float(v) for v in centre[i % 4] + spread * g.normal(size=dim)], int(g.integers(0, 5)), "g", 1) for i in range(n)]
    odd = [(50, [1.0, None] + [0.0] * (dim - 2), 1, "g", 1), (100, None, 1, "g", 1), (150, [float("nan")] * dim, 1, "g", 1), (151, [float("inf")] * dim, 1, "g", 1), (200, [1.0] * dim, None, "g", 1)]
    odd += [(250, [0.0] * dim, 2, "g", 1), (251, [], 2, "g", 1), (252, [1.0], 2, "g", 1), (None, [1.0] * dim, 2, "g", 1), (None, [1.0] * dim, 3, "g", 1)]
    return rows + odd + rows[:60]


def test_negatives(spark, monkeypatch):
    rows = vectors(600, 3)
    df = spark.createDataFrame(rows, VECTORS)
    want = plain(rows)
    assert mined(df) == want and len(want) > 100
    monkeypatch.setattr(negatives, "GROUP", 3)  # cells of several groups, groups of several cells
    assert mined(df) == want
    assert negatives.mined(df.limit(0)).count() == 0 and negatives.mined(df.where("vec_id % 50 <> 0")).count() == 0
    few = [r for r in rows if r[0] in (0, 1, 50, 101)][:4]
    assert mined(spark.createDataFrame(few, VECTORS)) == plain(few)


def test_negatives_large_numbers(spark):
    rows = [(i, [v * 1e9 for v in e], label, g, x) for i, e, label, g, x in vectors(120, 4)[:120]]
    got, want = mined(spark.createDataFrame(rows, VECTORS)), plain(rows)
    assert [re.sub(r"\d{19,}", "big", w) for w in got if "9223372036854775807" not in w] == [w for w in got if "9223372036854775807" not in w]
    small = [(i, [v * 1e5 for v in e], label, g, x) for i, e, label, g, x in vectors(120, 4)[:120]]
    assert mined(spark.createDataFrame(small, VECTORS)) == plain(small) and want


def test_negatives_prune():
    """A bound leaves out rows only where no anchor of the cell can use them."""
    g = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([g.normal(size=(300, 4)) * 0.02 + c for c in np.eye(4)]))
    norm = (x * x).sum(1)
    top = norm.max()
    pivots = np.column_stack([x[[0, 300, 600, 900]], np.sqrt(top - norm[[0, 300, 600, 900]])]) / np.sqrt(top)
    cells = negatives.Cells(pivots, top, 4)
    q = x[::50]
    d = cells.far(q, None)
    home = d.argmin(1)
    for c in range(4):
        own = q[home == c]
        cells.size[c], cells.radius[c] = len(own), d[home == c, c].max()
        cells.most[c], cells.least[c] = (own * own).sum(1).max(), (own * own).sum(1).min()
    cells.low[:], cells.high[:] = 60000, np.inf
    use, score = cells.serves(x, norm), q @ x.T
    assert not use.all() and all(use[:, home[i]][score[i] >= 60000].all() for i in range(len(q)))
    cells.low[:], cells.high[:] = -np.inf, 10000
    use = cells.serves(x, norm)
    assert not use.all() and all(use[:, home[i]][score[i] <= 10000].all() for i in range(len(q)))


def test_op12_whole_table(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = negatives.op12_negatives(spark, d)
    want = duckdb.sql(negatives.ORACLE_SQL)
    assert sorted(want.columns) == sorted(got.columns)
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {names} FROM ({negatives.ORACLE_SQL})").fetchall())


# Token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(counting.default_path())
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "l", "e", "v", "d", "m", " ", "  ", "\n", "\t", "a", "é", "9", "٣", "-", "<|endoftext|>", "<|endo", "ftext|>", "好", "😀", "S", "'LL", " '", "aaaa", "\x1c", "́", " "]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000)]
    out += ["a" * 30000, "ab" * 20000, " " * 5000 + "x", "\n" * 3000, "".join(r.choice("acgt") for _ in range(50000)), "-" * 9999, "好" * 3000]
    out += ["".join(r.choice("acgt ") for _ in range(1500000)), "".join(map(chr, range(0x20, 0xD800, 7)))]
    return out


def test_token_counts(library):
    t = texts()
    assert counting.counts_of(pa.array(t), counting.default_path()).tolist() == library(t)


def test_token_counts_compiled_anew(library, monkeypatch):
    """The table starts afresh when it is full, also inside a long pre-token."""
    monkeypatch.setattr(counting, "STATES", 50)
    monkeypatch.setattr(counting, "GROUP_BYTES", 2000)
    monkeypatch.setattr(counting, "PART_BYTES", 5000)
    t = texts()[2000:-2]
    assert counting.counts_of(pa.array(t), counting.default_path()).tolist() == library(t)


def test_prefix_scan():
    """Chunks of any size give the same starts."""
    r = np.random.default_rng(2)
    classes = r.integers(0, counting.CLASSES, 5000).astype(np.uint8)
    want = counting.scan(classes, 1 << 13)
    assert all((counting.scan(classes, c) == want).all() for c in (1, 2, 3, 64, 999))


def test_token_count_rows(spark, library):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (None, "x"), (1, "Hello, world"), (4, "word " * 600)]
    df = spark.createDataFrame([(*r, 5, 5) for r in rows], "doc_id long, text string, n_tokens int, n_bytes int")
    got = sorted(map(tuple, counting.counted(df).collect()), key=str)
    n = library([t or "" for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n, strict=True)), key=str)
    assert counting.counted(df.limit(0)).count() == 0


def test_op13_whole_table(spark, library):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    n = library([t or "" for _, t in docs])
    got = sorted(map(tuple, counting.op13_counting(spark, d).collect()))
    assert got == sorted((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(docs, n, strict=True))


# Page extraction and personal data


def _pages(spark, d="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{d}/pages.parquet")


def test_the_cut_decides(spark):
    """On pages that the model wasn't fitted on and whose elements and names tell nothing, the cut mends what the classifier gets wrong."""
    from geneframe.llm import extraction as X

    p = _pages(spark, "/root/testdata/sf0.1")
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 3 == 0
    model = X.fitted(p.where(~held))
    bare = lambda h: re.sub(r"<(/?)(?:article|nav|footer|header|aside|main|form)\b", r"<\1div", re.sub(r' (?:class|id|role)="[^"]*"', "", h))
    counts, changed, pages = {"cut": [0, 0, 0], "signs": [0, 0, 0]}, 0, 0
    for (html,) in p.where(held).select("html").limit(700).collect():
        labels = [X.weak_label(b) for b in X.blocks(html or "")[0]]
        found, parent, depth = X.blocks(bare(html or ""))
        if len(found) != len(labels):
            continue
        s = X.scores(found, model)
        sides = {"signs": [v > 0 for v in s], "cut": X.min_cut(s, X.smoothness(found, parent, depth, model.edges))}
        pages, changed = pages + 1, changed + (sides["cut"] != sides["signs"])
        for name, kept in sides.items():
            for k, y in zip(kept, labels, strict=True):
                if k or y:
                    counts[name][0 if k and y else 1 if k else 2] += 1
    f1 = {k: 2 * r / (2 * r + w + m) for k, (r, w, m) in counts.items()}
    assert pages > 300 and changed > 0.05 * pages and f1["cut"] > max(0.99, f1["signs"])
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><h1>A title of it</h1><p>{'This is a paragraph of prose, which goes on and on. ' * 4}</p><p>A second paragraph is shorter, but is prose.</p></div><div>Ann wrote: I liked this text very much.</div><div>All rights reserved 2024. Imprint.</div>"
    assert X.main_text(page, model).startswith("A title of it\n\nThis is") and X.main_text(page, model).endswith("but is prose.")


def test_op4_whole_table(spark):
    """The articles' texts by the standard library's parser."""
    from html.parser import HTMLParser

    from geneframe.llm import extraction as X

    class Articles(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.inside = [""], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "blockquote", "article"):
                self.parts.append("")
            elif tag == "br":
                self.parts[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "blockquote"):
                self.parts.append("")

        def handle_data(self, data):
            if self.inside:
                self.parts[-1] += data

    want = {}
    for page_id, html in _pages(spark).select("page_id", "html").collect():
        a = Articles()
        a.feed(html or "")
        want[page_id] = "\n\n".join(x for x in (" ".join(p.split()) for p in a.parts) if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in X.op4_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_added_spans(spark):
    """Labelled texts: what the method adds is right, what is there is found, and no card, address or number that fails its check."""
    from geneframe.llm import pii

    r = random.Random(9)
    token = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    rows, truth = [], set()
    for k in range(400):
        kind, word = k % 8, prose_of(r, 30)
        if kind == 0:
            span, name = "AKIA" + token(24), "secret"
        elif kind == 1:
            span, name = f"ann{k} [at] site{k} [dot] org", "email"
        elif kind == 2:
            span, name = f"({200 + k % 700}) {300 + k % 600}-{1000 + k}", "phone"
        elif kind == 3:
            span, name = "5731080387325255" if k % 16 == 3 else "4111111111111112", None
        elif kind == 4:
            span, name = f"300.{k % 256}.1.999", None
        elif kind == 5:
            span, name = "/".join(prose_of(r, 4).split()), None
        else:
            span, name = "", None
        lead = {"secret": "token = ", "email": "mail ", "phone": "phone "}.get(name, "card " if kind == 3 else "see ")
        if name:
            truth.add((k, name, len(word) + 1 + len(lead), len(word) + 1 + len(lead) + len(span)))
        rows.append((k, f"{word} {lead}{span} {word}"))
    got = set()
    for x in pii.decided(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got |= {(x["doc_id"], pii.KINDS[s["kind"]], s["start"], s["end"]) for s in x["_spans"] if not s["base"]}
    right = len(got & truth)
    assert not any(kind in ("card", "ip") for _, kind, _, _ in got)
    assert right >= 0.95 * len(got) and right >= 0.9 * len(truth)


def prose_of(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) for _ in range(n))


def test_no_added_span_fails_its_check(spark):
    """Whole tables: every added span of a kind with a check passes it."""
    from geneframe.llm import pii

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n = 0
    for x in pii.decided(d).join(d.withColumnRenamed("text", "whole"), "doc_id").select("whole", "_spans").collect():
        for s in x["_spans"]:
            if not s["base"]:
                n += 1
                assert pii.KINDS[s["kind"]] not in ("card", "ip"), x["whole"][s["start"] : s["end"]]
    assert n > 5
