"""Each operator against brute force, with nulls, empty texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geneframe.llm import bpe, embedding, extraction, langid, minhash, mixture, packing, pii, quality, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]) + str(r.randrange(200)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    a, b = prose(120, 1), prose(300, 2)
    texts = [a, a, a + " one more", b, b.replace(" ", "\n", 3), "", None, "x", "zz\n" * 4, prose(4000, 3), "mail me.x@site.org or +1 (234) 555-0199, 10.0.0.1 and 4111 1111 1111 1111", "😀 4111-1111-1111-1111 é a@b.c..d 999.1.1.1", a[:260] + prose(50, 4)]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 7) for i, t in enumerate(texts)]
    return [*out, (None, "x", None, None, 1, 7), out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_round_trip(docs, empty, rows):
    enc = bpe._encoding(bpe.default_path(), bpe.default_pattern())
    got = bpe.encoded(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in got) == sorted((i is None, i or 0, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert bpe.encoded(empty).count() == 0
    v = np.array([0, 1, 127, 128, 300, 2**21, 2**31])
    assert (bpe.unvarint(bpe.varint(v)[0]) == v).all()


def test_packing(docs, empty, rows):
    enc = bpe._encoding(bpe.default_path(), bpe.default_pattern())
    got, pieces = packing.packed(docs.where("doc_id <> 0"), length=64).collect(), {}
    for r in got:
        ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 64 and (ids[cu[-1] :] == packing.PAD).all()
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:]):
            pieces[d, s] = ids[a:b].tolist()
            assert pos[a:b].tolist() == list(range(b - a))
    for i, t, *_ in rows[1:-2]:
        assert sum((pieces[k] for k in sorted(k for k in pieces if k[0] == i)), []) == enc.encode_ordinary(t or "")
    assert packing.packed(empty).count() == 0
    sizes = np.random.default_rng(0).integers(1, 33, 300)
    plain = []  # best fit decreasing by looking at every row
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [k for k in range(len(plain)) if plain[k] >= s]
        k = min(fit, key=lambda k: plain[k]) if fit else plain.append(32) or len(plain) - 1
        plain[k] -= s
    packs = packing.best_fit_decreasing(sizes, 32)
    assert sorted(32 - sum(sizes[i] for i in p) for p in packs) == sorted(plain)


def test_mixture(docs, empty, rows):
    got = mixture.mixed(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= len(own)
    assert abs(sum(own[0]["target"] for own in by.values()) - sum(r["size"] for r in got)) < 1e-3
    assert sorted(map(str, got)) == sorted(map(str, mixture.mixed(docs).collect()))
    assert mixture.mixed(empty).count() == 0 and mixture.resampled(docs).columns == docs.columns


def test_quality(docs, empty, rows):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judged(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 1000 else set()
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)))
        if len(w) < 1000:
            assert r["n_repeat_words"] == len(covered)
    assert quality.judged(empty).count() == 0 and quality.filtered(docs).columns == docs.columns
    assert quality.filtered(docs).count() == sum(r["kept"] for r in quality.judged(docs).collect())


def test_minhash(spark, docs, empty):
    got = {r["doc_id"]: r for r in minhash.classes(docs).collect()}
    assert got[0]["class_id"] == got[1]["class_id"] == got[2]["class_id"] == 0 and got[0]["class_size"] == 4
    assert got[3]["class_id"] == got[4]["class_id"] == 3 and got[9]["class_size"] == 1
    assert got[5]["class_id"] == 5 and got[6]["class_id"] == 6
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id < 5").collect()) == [0, 3]
    assert minhash.classes(empty).count() == 0
    # sampling agrees with weighted Jaccard similarity
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    w = rng.uniform(0.5, 3, 60).astype(np.float32)
    rows, hh, ww = np.repeat([0, 1], 50), np.concatenate((h[:50], h[10:])), np.concatenate((w[:50], w[10:]))
    same = np.mean([x[0] == x[1] for x in minhash.samples(rows, hh, ww, 2, 3000)])
    assert abs(same - w[10:50].sum() / w.sum()) < 0.03


def test_suffix(docs, empty, rows):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for b in data:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = []
    for (i, *_), b in zip(rows, data):
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        want.append((str(i), len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.stripped(docs).collect()]
    assert sorted(got) == sorted(want) and suffix.stripped(empty).count() == 0


def test_suffix_large_gram(spark, monkeypatch):
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    passage = word(320)
    # a passage in all texts, between text of their own that every third pair of them shares
    sides = [word(160) for _ in range(40)]
    texts = [sides[i // 3] + passage + (sides[-1 - i // 3] if i % 3 else word(90)) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x["doc_id"]: (x["n_removed"], x["n_spans"], x["kept"]) for x in suffix.stripped(d).collect()}
    for limit in (1500, 4000, 1):
        monkeypatch.setattr(suffix, "SHARD_BYTES", limit)
        regions = []
        fold = suffix._folded
        monkeypatch.setattr(suffix, "_folded", lambda t, x: regions.append(x.count()) or fold(t, x))
        got = {x["doc_id"]: (x["n_removed"], x["n_spans"], x["kept"]) for x in suffix.stripped(d).collect()}
        monkeypatch.setattr(suffix, "_folded", fold)
        assert got == want and regions[0] > 0


@pytest.mark.parametrize("memory, limit", [(0, 0), (4, 100), (1 << 20, 1 << 30)])
def test_suffix_order(memory, limit):
    r = random.Random(memory)
    for _ in range(60):
        n, k, depth = r.randint(1, 60), r.choice([1, 2, 3, 200]), r.choice([3, 100])
        t = np.array([r.randrange(k) for _ in range(n)])
        order, lcp = suffix.suffix_order(t, depth, memory, limit)
        assert sorted(order) == list(range(n))
        for a, b, x in zip(order[:-1], order[1:], lcp[1:]):
            c = 0
            while c < depth and max(a, b) + c < n and t[a + c] == t[b + c]:
                c += 1
            assert c == x and tuple(t[a : a + depth]) <= tuple(t[b : b + depth])


def test_embedding(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    x = [(base[i % 6] + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist() for i in range(150)]
    rows = [(i, v, i % 2) for i, v in enumerate(x)] + [(150, x[0], 0), (151, None, 0), (152, [0.0] * 16, 1), (153, [float("nan")] * 16, 1), (154, x[0], None), (155, [1.0, 2.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block, per_cell in ((embedding.BLOCK, embedding.PER_CELL), (8, embedding.PER_CELL), (embedding.BLOCK, 10), (8, 25)):
        monkeypatch.setattr(embedding, "BLOCK", block)
        monkeypatch.setattr(embedding, "PER_CELL", per_cell)
        got = {r["vec_id"]: r for r in embedding.linked(v).collect()}
        ok = [i for i, e, label in rows if e and len(e) == 16 and label is not None and i < 151]
        u = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
        link = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.93] for i in ok}
        for i, _, _ in rows:
            assert got[i]["n_links"] == len(link.get(i, []))
            reach, todo = {i}, [i]
            while todo:
                for j in link.get(todo.pop(), []):
                    if j not in reach:
                        reach.add(j)
                        todo.append(j)
            assert got[i]["component_id"] == min(reach)
    assert embedding.linked(v.limit(0)).count() == 0


def test_pii(docs, empty, rows):
    got = {(r["doc_id"], r["text"]): r["_spans"] for r in pii.decided(docs).collect()}
    for i, t, *_ in rows:
        found = {(pii.KINDS[s["kind"]], (t or "")[s["start"] : s["end"]]) for s in got[i, t]}
        want = {10: {("email", "me.x@site.org"), ("phone", "+1 (234) 555-0199"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")}, 11: {("card", "4111-1111-1111-1111"), ("email", "a@b.c")}}.get(i, set())
        assert want <= found and (want or not found)
    red = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert red[10]["text"] == "mail <EMAIL> or <PHONE>, <IP> and <CARD>" and red[10]["n_chars"] == len(red[10]["text"]) and red[6]["text"] is None
    assert pii.decided(empty).count() == 0
    # labelers: two good ones outvote a random one
    r = random.Random(1)
    votes = {}
    for _ in range(2000):
        y = r.random() < 0.4
        v = "".join(str(int(y if r.random() < p else not y)) for p in (0.95, 0.9, 0.5, 0.85, 0.8))
        votes[v] = votes.get(v, 0) + 1
    _, tables, post = pii.reliabilities(votes)
    assert tables[0][1][1] > 0.85 and 0.3 < tables[2][1][1] < 0.7 and post["11011"] > 0.9 > 0.1 > post["00100"]


def test_pii_digits_apart(spark):
    texts = ["ping 8.8.8.8 now", "DNS 1.1.1.1", "pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 please", "pay 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["_spans"] if s["base"]] for r in pii.decided(d).collect()}
    assert got == {0: [("ip", "8.8.8.8")], 1: [("ip", "1.1.1.1")], 2: [("card", texts[2][4:35])], 3: [("card", texts[3][4:])]}
    assert [r["text"] for r in pii.redacted(d).orderBy("doc_id").collect()] == ["ping <IP> now", "DNS <IP>", "pay <CARD> please", "pay <CARD>"]


def test_langid(spark):
    words = {"aa": ["nabo", "tiru", "kelo", "suma"], "bb": ["schrik", "wolk", "brand", "tolch"]}
    r = random.Random(0)
    rows = [(i, " ".join(r.choices(words[lang], k=20)), lang) for i in range(60) for lang in [("aa", "bb")[i % 2]]] + [(100, None, "aa"), (101, "123 !", "aa"), (102, "x" * 500, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.predicted(d, langid.learned(d.where(~langid.held_out(F.col("doc_id"))))).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:60]) and got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    # the forward sum is the sum over all segmentations
    lattice = langid.Lattice(["▁", "a", "b", "ab", "▁a", "ba"])
    p = np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.2], [0.05], [0.0]])
    probability = dict(zip(["▁", "a", "b", "ab", "▁a", "ba"], p[:6, 0]))

    def total(w):
        return 1.0 if not w else sum(probability[w[:k]] * total(w[k:]) for k in (1, 2) if k <= len(w) and w[:k] in probability)

    assert abs(lattice.forward(["▁abab"], p)[0, 0] - np.log(total("▁abab"))) < 1e-12
    assert langid.predicted(d, langid.learned(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_langid_cache_starts_anew(monkeypatch):
    from types import SimpleNamespace

    pieces = [langid._START, *"abcdefgh"]
    r = random.Random(5)
    model = langid.Model(pieces, [(lang, i, r.random() * 100) for lang in ("aa", "bb") for i in range(len(pieces))])
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(30)) for _ in range(80)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t], "held_out": [False]}) for i, t in enumerate(texts)]
    got = {}
    for limit in (0, 600, 1 << 40):  # 600 words: more than 16 slices come before the cache is full
        monkeypatch.setattr(langid, "CACHE", limit)
        got[limit] = [(x["lang_pred"], x["score"]) for b in langid._score(SimpleNamespace(value=model))(batches) for x in b.to_pylist()]
    assert got[600] == got[0] == got[1 << 40] and {x for x, _ in got[0]} == {"aa", "bb"}


def test_extraction(spark):
    html = "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; line</h1><p>First   para <b>bold</b>.<p>Second &eacute;.<div class=comments><p>A reader says so.</p></div></article><footer>&copy; us</footer>"
    got = {r["page_id"]: r for r in extraction.extracted(spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", "")], "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & line\n\nFirst para bold.\n\nSecond é." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == ""
    rng = random.Random(0)
    for _ in range(30):  # the cut against every labelling
        n = rng.randint(1, 7)
        s = [rng.choice([-2, -1, 0.5, 1, 2]) for _ in range(n)]
        e = [(a, b, rng.choice([0.3, 0.8])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        cost = lambda y: sum(-x if x < 0 and k else x if x > 0 and not k else 0 for x, k in zip(s, y)) + sum(w for a, b, w in e if y[a] != y[b])  # noqa: B023, E731
        assert abs(cost(extraction.min_cut(s, e)) - min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))) < 1e-9


# Queries against brute force


def _base_spans(text):
    """The base patterns as the contract states them."""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(m):
        d = [int(c) for c in reversed(digits(m))]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: hand-made rows, nulls, a long text, clashing and extra columns."""
    r = random.Random(11)
    pool = ["8.8.8.8", "4111 1111 1111 1111", "a.b@c-d.org", "+1 (234) 555-0199", "x", "é", "😀", "1.2.3", "..", "@", "+", "-", " ", "\n", "12", "4", "00", "token = \"9f8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d\"", "a@b", "me [at] site [dot] org", "call 234-555-0199", "password: hunter2hunter2X9"]
    texts = ["".join(r.choices(pool, k=r.randint(1, 12))) for _ in range(300)] + ["".join(r.choices("0123456789.-+@ab ()", k=40)) for _ in range(300)]
    texts += [None, "", " ".join(pool) + " " + prose(3000, 5) + " 9.9.9.9", prose(5000, 8)]
    base = [prose(150, 100 + k) for k in range(12)]
    for k, t in enumerate(base):  # copies with more and more words changed
        w = t.split()
        for n in (0, 1, 2, 4, 6, 9):
            x = list(w)
            for j in r.sample(range(len(w)), n):
                x[j] = f"new{k}x{j}"
            texts.append(" ".join(x))
    langs, sources = ["en", None, "de"], ["a", "b", None, "c"]
    rows = [(i, t, langs[i % 3], sources[i % 4], len(t or ""), f"e{i}") for i, t in enumerate(texts)] + [(None, base[0], None, None, 1, "n"), (0, texts[0], "en", "a", 3, "again")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _t string").write.parquet(str(path / "documents.parquet"))
    pages = [(1, "u", "<article><h1>A</h1><p>First text here.</p></article>"), (2, "v", None), (3, None, ""), (1, "u", "<article><h1>A</h1><p>First text here.</p></article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path), rows


def test_op1_base_spans(spark, folder):
    path, rows = folder
    got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.op1_pii(spark, path).collect())
    want = []
    for i, t, *_ in rows:
        s = _base_spans(t or "")
        want.append((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(), *(sum(k == x for k, *_ in s) for x in pii.BASE_KINDS)))
    assert got == sorted(want)


def test_pii_adds_secrets_and_keeps_columns(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    texts = {r[5]: r[1] or "" for r in rows}
    spans = {r["_t"]: [(pii.KINDS[s["kind"]], texts[r["_t"]][s["start"] : s["end"]]) for s in r["_spans"]] for r in pii.decided(docs).collect()}
    assert set(spans) == set(texts)  # an input column _t passes through
    added = {v for x in spans.values() for k, v in x if k == "secret"}
    assert "9f8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d" in added
    red = {r["_t"]: r for r in pii.redacted(docs).collect()}
    found = {r["_t"]: r["_spans"] for r in pii.decided(docs).collect()}
    for key, t in texts.items():
        out, upto = "", 0
        for s in found[key]:
            if s["start"] >= upto:
                out += t[upto : s["start"]] + f"<{pii.KINDS[s['kind']].upper()}>"
            upto = max(upto, s["end"])
        assert (red[key]["text"] or "") == out + t[upto:]


def test_redaction_of_a_long_text(spark):
    text = "😀 some words é " * 3000 + "a@b.org" + " x" * 5000 + " 8.8.8.8" * 300 + " end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redacted(d).first()["text"] == text.replace("a@b.org", "<EMAIL>").replace("8.8.8.8", "<IP>")


def test_op3_digests(spark, folder):
    path, rows = folder
    enc = bpe._encoding(bpe.default_path(), bpe.default_pattern())
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op3_bpe(spark, path).collect()) == sorted(want)


def test_op7_spans(spark, folder):
    path, rows = folder
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for b in data:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = []
    for (i, *_), b in zip(rows, data):
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[1:-1] == 0]) if b else b""
        want.append((str(i), len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in suffix.op7_suffix(spark, path).collect()) == sorted(want)


def test_suffix_on_disk(spark, docs, monkeypatch):
    want = sorted(map(str, suffix.stripped(docs).collect()))
    monkeypatch.setattr(suffix, "SORT", {"memory": 50, "limit": 64})  # recursion, and all that lasts in files
    assert sorted(map(str, suffix.stripped(docs).collect())) == want


def _shingle_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = {}
    for k in range(len(w) - 4):
        g = tuple(w[k : k + 5])
        out[g] = out.get(g, 0) + 1
    return out


def test_op10_against_all_pairs(spark, folder):
    path, rows = folder
    got = {r["doc_id"]: r["class_id"] for r in minhash.op10_minhash(spark, path).where("doc_id is not null").collect()}
    rows = [r for r in rows if r[0] is not None]
    sets = {r[0]: _shingle_counts(r[1]) for r in rows if len((r[1] or "").split()) >= 5}
    df, n = {}, len(rows) + 1
    for s in sets.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    weigh = {g: 1 + min(1.0, max(0.0, np.log(n / c)) / np.log(minhash.RARE)) for g, c in df.items()}
    linked, apart, edges = 0, 0, {i: {i} for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and not sets[a].keys().isdisjoint(sets[b]):
                both = sets[a].keys() | sets[b].keys()
                low, high = (sum(weigh[g] * f(sets[a].get(g, 0), sets[b].get(g, 0)) for g in both) for f in (min, max))
                if low / high >= 0.81:  # a little above the threshold: weights come from a sketch
                    linked += 1
                    assert got[a] == got[b]
                if low / high >= 0.79:
                    edges[a].add(b)
                    edges[b].add(a)
    for a in ids:  # what is joined is joined by a chain of pairs at the threshold
        reach, todo = {a}, [a]
        while todo:
            for x in edges[todo.pop()] - reach:
                reach.add(x)
                todo.append(x)
        apart += sum(got[b] == got[a] and b not in reach for b in ids)
    assert linked > 20 and apart == 0


def test_op6_against_plain_sums(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    model = langid.learned(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    number = {p: i for i, p in enumerate(model.pieces)}
    longest, unknown = max(map(len, model.pieces)), len(model.pieces)

    def log_sum(word, k):
        total = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for size in range(1, min(longest, j) + 1):
                piece = number.get(word[j - size : j], unknown if size == 1 else None)
                total[j] += 0 if piece is None else total[j - size] * model.p[piece, k]
        return np.log(total[-1])

    got = {}
    for r in langid.op6_langid(spark, path).collect():
        got[r["doc_id"]] = r
    for i, t, *_ in rows[580:640]:
        words = ["▁" + w for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if w.isalpha()]
        if not words:
            assert got[i]["lang_pred"] == "und"
            continue
        logs = [sum(log_sum(w, k) for w in words) for k in range(len(model.langs))]
        assert model.langs[int(np.argmax(logs))] == got[i]["lang_pred"] and abs(got[i]["score"] - 1 / sum(np.exp(np.array(logs) - max(logs)))) < 1e-6
    assert langid.letters("½ ² Ⅷ 12") == []


def test_long_runs_of_letters(monkeypatch):
    pieces = ["▁", *"abcd", "ab", "▁a", "bcd", "abcdabcd"]
    lattice, r = langid.Lattice(pieces), np.random.default_rng(1)
    p = r.uniform(0.01, 0.2, (len(pieces) + 2, 2))
    p[-1] = 0
    words = ["▁" + "".join(r.choice(list("abcdx"), 30)) for _ in range(5)]
    counts = np.arange(1.0, 6.0)
    short, counted = lattice.forward(words, p), lattice.expected(words, counts, p[:, 0])
    monkeypatch.setattr(langid, "LONG", 0)
    monkeypatch.setattr(langid, "LOOK", 7)
    assert np.allclose(lattice.forward(words, p), short, atol=1e-9) and np.allclose(lattice.expected(words, counts, p[:, 0]), counted, atol=1e-9)
    assert np.isfinite(lattice.forward(["▁" + "ab" * 20_000], p)).all()


def test_op4_rows(spark, folder):
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in extraction.op4_extraction(spark, folder[0]).collect())
    assert got == [(1, "u", "A\n\nFirst text here.", 19), (1, "u", "A\n\nFirst text here.", 19), (2, "v", "", 0), (3, "", "", 0)]
    assert extraction.extracted(spark.read.parquet(folder[0] + "/pages.parquet").limit(0)).count() == 0


def test_extraction_keeps_and_drops():
    html = """<body><nav><a href=/>Home</a></nav><div class=cookie-banner>We use cookies to make this site better for you all.</div>
    <article><header><h1>Title</h1></header><div class="share-price"><p>Share price rose today.</p></div><p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> inside
    a text.</p><object>An object.</object><noscript>No script.</noscript><ul><li>One<li>Two</ul><table><tr><td>a<td>b<tr><td>c</table>
    <div class="social share-buttons">Share this with friends.</div><div class=comments><p>A reader says a long thing here, with an end.</p></div>
    <aside><p>Something else is told here at some length.</p></aside><form><p>Your name</p></form></article><footer>&copy; us</footer>"""
    assert extraction.main_text(html) == "Title\n\nShare price rose today.\n\nWith x=1 inside a text.\n\nAn object.\n\nNo script.\n\nOne\n\nTwo\n\na\n\nb\n\nc"
    assert extraction.main_text("<p>1 < 2 &amp; \"3 > 2\" are both true, as all know.") == '1 < 2 & "3 > 2" are both true, as all know.'
    assert extraction.main_text("<article>a <!-- x --> b<br>c</article>") == "a b c"


@pytest.mark.parametrize("part", ["<div><p>x", '<a "', "<b>x", "<", "<! ", "<a href='", "<figure><td><li>x", "</p></div>x", "<!--", "<script>"])
def test_extraction_is_linear(part):
    import time

    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        extraction.main_text(part * n)
        times.append(time.process_time() - began)
    assert times[1] < 9 * times[0] + 0.5


def test_quality_thresholds_follow_the_data(spark):
    rows = [(i, " ".join(["word", "other", "thing"][k % 3] + str((i * 31 + k) % 997) + ("&" if i < 200 and k % 5 == 0 else "") for k in range(100 + i % 50)), "en", "code" if i < 200 else "prose") for i in range(400)]
    rows += [(400, " ".join(f"w{k}###" for k in range(100)), "en", "prose"), (401, " ".join(f"w{k}###" for k in range(100)), "de", "tiny"), (402, None, None, None)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(400))  # a fifth of all words of one source have symbols, and there that is usual
    assert not got[400]["kept"] and not got[401]["kept"] and not got[402]["kept"]
    assert got[0]["symbol_rate_most"] > 10 * got[300]["symbol_rate_most"]


def test_columns_pass_whatever_their_names(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(path + "/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(-7).alias("size"), F.lit(-8).alias("_hash"), F.lit(-9).alias("n_words"), F.lit(-1).alias("kept"), F.lit(-2).alias("_row"), F.lit(-3).alias("target"))
    for f in (mixture.resampled, quality.filtered, minhash.deduplicated, pii.redacted):
        out = f(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select("size", "_hash", "n_words", "kept", "_row", "target").distinct().collect()} == {(-7, -8, -9, -1, -2, -3)}


def test_embedding_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (3, [0.01, 1.0], 0), (4, [1.0, 0.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]


def test_packed_files(spark, docs, tmp_path):
    rows = packing.packed(docs, length=64)
    packing.save(rows, str(tmp_path / "packed"), 64)
    plain = lambda d, s, c, i, p: str((list(d), list(s), list(c), bytes(i), bytes(p)))
    want = sorted(plain(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["ids"], r["positions"]) for r in rows.collect())
    assert sorted(plain(*x[:3], x[3].tobytes(), x[4].tobytes()) for x in packing.load(str(tmp_path / "packed"))) == want
    t = prose(400, 1) + "  é\n\n x"
    path, pattern = bpe.default_path(), bpe.default_pattern()
    whole = packing.token_ids(t, path, pattern).tolist()
    packing.LONG_TEXT, old = 5, packing.LONG_TEXT
    try:
        assert packing.token_ids(t, path, pattern).tolist() == whole
    finally:
        packing.LONG_TEXT = old


def test_hashes_in_chunks(monkeypatch):
    from geneframe.llm import common

    data = np.frombuffer(prose(300, 7).encode() + b"  \n" + prose(20, 1).encode(), np.uint8)
    offsets = np.array([0, 0, 100, 101, 700, len(data), len(data)])
    starts, ends, rows = common.words(data, offsets)
    whole = common.hashes(data, starts, ends)
    monkeypatch.setattr(common, "HASH_BYTES", 4)
    monkeypatch.setattr(common.Rolling, "_up", None)
    a, b, c = common.words(data, offsets)
    assert (a == starts).all() and (b == ends).all() and (c == rows).all() and (common.hashes(data, a, b) == whole).all()
    monkeypatch.setattr(common.Rolling, "_up", None)
