"""The pipeline's stages on a small input."""

import numpy as np

import corpus_pipeline
from geneframe.llm import bpe


def test_stages(spark, tmp_path):
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate([*clean, clean[0], clean[1] + " end", "junk " * 40, clean[5] + " a@b.org"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        seen.append(sorted({r["doc_id"] for r in docs.collect()}))
    assert seen[0] == [0, 1, 2, 3, 4, 5, 6, 7, 9] and seen[1] == seen[2] == [0, 1, 2, 3, 4, 5]
    enc = bpe._encoding(bpe.default_path(), bpe.default_pattern())
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(clean[r["doc_id"]])


def test_run_against_plain_python(spark, tmp_path):
    """run() on a small corpus, and each stage's decisions by other means: words and sets in plain Python, regular expressions, sums."""
    import random
    import re

    r = random.Random(3)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "no") for b in ("ren", "dal", "vik", "os", "um")]
    clean = [" ".join(r.choices(words, k=r.randint(60, 200))) for _ in range(120)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in clean[:20]]
    junk = ["again and again " * 30, "few words", None, "", " ".join("###" for _ in range(80))]
    secret = [t + " mail me@site.org or 8.8.8.8" for t in (" ".join(r.choices(words, k=90)) for _ in range(10))]
    texts = [*clean, *near, *clean[:10], *junk, *secret]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    left = [i for i in range(len(texts)) if i not in range(150, 155)]
    stays = [i for i in left if not any(j < i and len(shingles[i] & shingles[j]) >= 0.85 * len(shingles[i] | shingles[j]) for j in left)]
    plain = {i: re.sub(r"\b8\.8\.8\.8\b", "<IP>", (texts[i] or "").replace("me@site.org", "<EMAIL>")) for i in stays}
    size = {s: sum(len(plain[i].split()) for i in stays if i % 3 == s) for s in range(3)}
    target = {s: sum(size.values()) * (s + 1) / 6 for s in range(3)}  # no source is asked for three times its size
    enc = bpe._encoding(bpe.default_path(), bpe.default_pattern())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} <= set(stays) and all(np.frombuffer(x["ids"], "<u4").tolist() == enc.encode_ordinary(plain[x["doc_id"]]) for x in got)
    for s in range(3):
        taken = [x["doc_id"] for x in got if x["doc_id"] % 3 == s]
        assert abs(sum(len(plain[i].split()) for i in taken) - target[s]) <= max(len(plain[i].split()) for i in stays)
        if target[s] >= size[s]:
            assert set(taken) == {i for i in stays if i % 3 == s}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
