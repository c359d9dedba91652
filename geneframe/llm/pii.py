"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides. DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Kinds with a base pattern, and one that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Leftmost matches of the base patterns, written so that no match and no failure takes more than linear time or a deep stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])(?:(?![ -](?![0-9]))[0-9 -])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Patterns of candidates that only the method can add, looked for outside the base matches of the same kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    # keys, tokens and passwords: a run of 16 or more with a digit in it
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+",
}
# Gazetteers. Top-level domains, issuers' card prefixes, calling codes, prefixes of issued tokens, names of secret settings.
DOMAINS = "com org net edu gov mil int info biz name pro io ai dev app de fr es uk eu it nl ch at be dk se no fi pl pt cz gr ie ru ua tr us ca mx br ar cl co au nz jp cn kr in id sg hk tw za il ae test".split()
#: First digits of a card number, from and to, and its lengths.
ISSUERS = (("4", "4", (16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("300", "305", (14, 16, 19)), ("36", "36", (14, 16, 19)), ("38", "39", (14, 16, 19)), ("62", "62", (16, 17, 18, 19)), ("2200", "2204", (16, 17, 18, 19)), ("50", "50", (16, 17, 18, 19)), ("56", "58", (16, 17, 18, 19)))
CALLING = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
CALLING[3] = [str(x) for a, b in ((211, 213), (216, 269), (290, 291), (297, 299), (350, 359), (370, 389), (420, 423), (500, 509), (590, 599), (670, 692), (850, 856), (880, 886), (960, 977), (992, 998)) for x in range(a, b + 1)]
TOKENS = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk- sk_live_ pk_live_ rk_live_ xoxb- xoxp- xoxa- AIza ya29. eyJ npm_ pypi- hf_ dop_v1_ SG.".split()
SETTINGS = "token secret password passwd passphrase pwd apikey api_key api-key key access_key private_key auth authorization bearer credential credentials signature session".split()
CUE = {
    "email": r"(?i)(?:mail|contact|write to|correo|courriel)[^A-Za-z0-9]{0,4}$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|from)[^A-Za-z0-9]{0,4}$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|account|konto|payment)[^A-Za-z0-9]{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon)[^A-Za-z0-9]{0,4}$",
    "secret": r"[=:][ \t]*[\"'`]?$",
}
DENY = r"(?i)(?:\bv|version|commit|sha[0-9]*|md5|hash|checksum|etag|revision|isbn|order|\bno|\bnr|\bid|serial|section|figure|page)[ .:#]{0,3}$"
#: Votes: 0 no, 1 yes, 2 none. Labelers: pattern, validity, gazetteer, context, boundary.
LABELERS, EM_ROUNDS, CHUNK, RARE = 5, 30, 256, 1.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def step(total, i):
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(False)


def _base(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    return {"email": lambda: F.lit(True), "ip": lambda: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "card": lambda: _luhn(m), "phone": lambda: F.length(_digits(m)).between(10, 15)}[kind]()


def _pattern(kind: str, m: Column, strict: bool) -> Column:
    """The regex labeler."""
    if kind == "secret":
        return m.rlike(r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_/+=-]{20,}$")
    return _base(kind, m) if strict else F.lit(False)


def _valid(kind: str, m: Column) -> Column:
    return {
        "email": lambda: ~m.rlike(r"^[.]|[.][.]|[.]@"),
        "ip": lambda: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") & ~m.rlike(r"(?:^|\.)0[0-9]"),
        "card": lambda: _luhn(m),
        "phone": lambda: F.length(_digits(m)).between(10, 15) & ~m.rlike(r"[.-]{2}|\([^)]*\("),
        "secret": lambda: F.size(F.array_distinct(F.split(F.lower(m), ""))) >= 9,  # a random run has many different symbols
    }[kind]()


def _listed(kind: str, m: Column, before: Column) -> Column:
    """The gazetteer labeler."""
    d = _digits(m)

    def issued() -> Column:
        found = F.lit(False)
        for low, high, sizes in ISSUERS:
            found = found | (F.left(d, F.lit(len(low))).between(low, high) & F.length(d).isin(*sizes))
        return found

    def called() -> Column:
        abroad = F.lit(False)
        for n, codes in CALLING.items():
            abroad = abroad | F.left(d, F.lit(n)).isin(*codes)
        return F.when(m.startswith("+"), abroad).otherwise(d.rlike("^[2-9]"))  # a national number

    return {
        "email": lambda: F.lower(F.regexp_extract(m, "[A-Za-z0-9-]+$", 0)).isin(*DOMAINS),
        "ip": lambda: ~m.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."),
        "card": issued,
        "phone": called,
        "secret": lambda: m.rlike("^(?:" + "|".join(re.escape(t) for t in TOKENS) + ")") | F.lower(F.regexp_extract(before, r"([A-Za-z_-]+)[^A-Za-z_-]*$", 1)).isin(*SETTINGS),
    }[kind]()


def _vote(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(0)


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike(r"[\p{L}]"), 3).otherwise(4)


def _found(name: str, text: Column, pattern: str, likely: Column) -> dict[str, Column]:
    """Two columns: the pieces between the matches, and the matches; null where there can be none."""
    return {f"{name}_p": F.when(likely, F.split(text, pattern, -1)), f"{name}_m": F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))}


def _candidates(kind: str, found: str, strict: bool) -> Column:
    """Array of candidates with start and end in code points. Starts are sums of lengths, taken in chunks: no text is walked twice."""
    p, m, gaps, heads = F.col(f"{found}_p"), F.col(f"{found}_m"), F.col(f"{found}_gaps"), F.col(f"{found}_heads")

    def one(x, i):
        chunk = F.floor(i / CHUNK).cast("int")
        start = F.get(heads, chunk) + F.aggregate(F.slice(gaps, chunk * CHUNK + 1, i - chunk * CHUNK + 1), F.lit(0), lambda a, b: a + b)
        before, after = F.get(p, i), F.get(p, i + 1)
        left, right = F.when(F.length(before) > 0, F.right(before, F.lit(1))).otherwise(""), F.left(after, F.lit(1))
        context = F.right(before, F.lit(24))
        base = _base(kind, x) if strict else F.lit(False)
        free = lambda c: ~c.rlike("[A-Za-z0-9]")
        votes = (_pattern(kind, x, strict), _valid(kind, x), _listed(kind, x, context), None, free(left) & free(right))
        cue = F.when(context.rlike(CUE[kind]), 1).when(context.rlike(DENY), 0).otherwise(2)
        votes = F.concat(*((_vote(v) if v is not None else cue).cast("string") for v in votes))
        traits = F.concat_ws(",", F.least(F.floor(F.length(x) / 4), F.lit(15)), F.least(F.length(_digits(x)), F.lit(20)), _side(left), _side(right))
        return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x)).cast("long").alias("end"), base.alias("base"), votes.alias("votes"), traits.alias("traits"))

    # gaps and heads are named twice, so the optimiser doesn't move their making into the lambda, where each match would repeat it
    return F.when((F.size(m) > 0) & (F.size(heads) > 0) & (F.size(gaps) > 0), F.transform(m, one))


def spotted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(_row, _text, _spans): the kept columns of docs as a struct, so that no name can clash; every candidate of every kind.

    A candidate: start, kind, end, base, votes, traits. Empty for null text.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("_row")
    d = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    # each is necessary for a match of the pattern
    likely = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9][ -]?[0-9]"), "phone": F.contains(t, F.lit("+"))}
    d = d.withColumns({n: c for k in BASE_KINDS for n, c in _found(f"_{k}", t, BASE[k], likely[k]).items()})

    def rest(k: str) -> Column:
        p, m = F.col(f"_{k}_p"), F.col(f"_{k}_m")
        masked = F.array_join(F.transform(p, lambda x, i: F.concat(x, F.repeat(F.lit("\x00"), F.coalesce(F.length(F.get(m, i)), F.lit(0))))), "")
        return F.when(F.size(m) > 0, masked).otherwise(t)

    d = d.withColumns({f"_r{k}": rest(k) if k in BASE else t for k in LOOSE})
    maybe = {"email": t.rlike(r"[(\[]at[)\]]"), "phone": t.rlike("[0-9]{3}[ .-][0-9]{4}"), "secret": t.rlike("[A-Za-z0-9_/+=-]{16}")}
    d = d.withColumns({n: c for k in LOOSE for n, c in _found(f"_l{k}", F.col(f"_r{k}"), LOOSE[k], maybe[k]).items()})
    found = [*((k, f"_{k}", True) for k in BASE_KINDS), *((k, f"_l{k}", False) for k in LOOSE)]
    plus = lambda a, b: a + b

    def gaps(f: str) -> Column:
        p, m = F.col(f"{f}_p"), F.col(f"{f}_m")
        return F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))

    def sums(f: str) -> Column:
        g = F.col(f"{f}_gaps")
        chunks = F.sequence(F.lit(0), F.floor((F.size(g) - 1) / CHUNK).cast("int"))
        return F.when(F.size(g) > 0, F.transform(chunks, lambda b: F.aggregate(F.slice(g, b * CHUNK + 1, F.lit(CHUNK)), F.lit(0), plus)))

    def heads(f: str) -> Column:
        c = F.col(f"{f}_sums")
        return F.transform(c, lambda x, i: F.aggregate(F.slice(c, F.lit(1), i), F.lit(0), plus))

    for name, make in (("gaps", gaps), ("sums", sums), ("heads", heads)):
        d = d.withColumns({f"{f}_{name}": make(f) for _, f, _ in found})
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,base:boolean,votes:string,traits:string>>)")
    d = d.withColumn("_spans", F.concat(*(F.coalesce(_candidates(k, f, strict), none) for k, f, strict in found)))
    return d.select("_row", F.col("_t").alias("_text"), "_spans")


def reliabilities(patterns: dict[str, float]) -> tuple[float, list[list[list[float]]], dict[str, float]]:
    """Dawid and Skene's EM over vote patterns and their counts: the prior, P(vote | label) by labeler, and each pattern's posterior."""
    posterior = {v: (v.count("1") + 0.5) / (v.count("1") + v.count("0") + 1) for v in patterns}
    prior, tables = 0.5, [[[1 / 3] * 3, [1 / 3] * 3] for _ in range(LABELERS)]
    for _ in range(EM_ROUNDS):
        total = sum(patterns.values())
        yes = sum(n * posterior[v] for v, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        tables = []
        for k in range(LABELERS):
            c = [[0.5] * 3, [0.5] * 3]
            for v, n in patterns.items():
                c[1][int(v[k])] += n * posterior[v]
                c[0][int(v[k])] += n * (1 - posterior[v])
            own = [[x / sum(row) for x in row] for row in c]
            if own[1][1] * own[0][0] < own[0][1] * own[1][0]:  # a vote for must not speak against: else the labels could change places
                own = [[(x + y) / 2 for x, y in zip(*own, strict=True)]] * 2
            tables.append(own)
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[k][1][int(v[k])] / tables[k][0][int(v[k])]) for k in range(LABELERS))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            # a pattern that hardly occurs is believed in proportion to its count
            posterior[v] = (patterns[v] * posterior[v] + RARE * prior) / (patterns[v] + RARE)
    return prior, tables, posterior


def fitted(candidates: DataFrame) -> dict[str, float]:
    """The span classifier: log odds by 'kind' (its prior) and 'kind/trait/value', a naive Bayes model over traits and votes.

    It is trained on the posteriors of EM over all candidates. What comes to the driver are counts by kind, vote pattern, trait and value:
    at most 5 * 3**5 * 60 rows, whatever the data.
    """
    # explode() would push a filter on the array below the projections that make it, and so make it again for each
    c = candidates.select(F.explode_outer("_spans").alias("s")).where("s is not null").select("s.kind", "s.votes", F.explode(F.transform(F.split("s.traits", ","), lambda x, i: F.concat_ws("/", i, x))).alias("trait"))
    counts = defaultdict(lambda: defaultdict(dict))
    for r in c.groupBy("kind", "votes", "trait").agg(F.count("*").alias("n")).collect():
        counts[r["kind"]][r["votes"]][r["trait"]] = r["n"]
    model: dict[str, float] = {}
    for kind, by_votes in counts.items():
        patterns = {v: float(sum(n for t, n in x.items() if t.startswith("0/"))) for v, x in sorted(by_votes.items())}
        prior, tables, posterior = reliabilities(patterns)
        model[str(kind)] = math.log(prior / (1 - prior))
        seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
        for v, x in by_votes.items():
            for trait, n in x.items():
                seen[trait][0] += n * (1 - posterior[v])
                seen[trait][1] += n * posterior[v]
        no, yes = (sum(n * (posterior[v] if label else 1 - posterior[v]) for v, n in patterns.items()) + 1 for label in (0, 1))
        for trait, (a, b) in seen.items():
            model[f"{kind}/{trait}"] = math.log((b / yes) / (a / no))
        for k in range(LABELERS):
            for vote in range(3):
                model[f"{kind}/v{k}/{vote}"] = math.log(tables[k][1][vote] / tables[k][0][vote])
    return {k: round(v, 9) for k, v in model.items()}


def _accepted(s: Column, model: dict[str, float]) -> Column:
    """The classifier decides: a span whose odds are above 1. A base span stays, whatever they are; one that its kind's check refuses (a
    card by its digits, an address or a phone number by their numbers) goes, whatever they are: it only teaches the classifier."""
    if not model:
        return s["base"]
    known = F.create_map(*(F.lit(x) for kv in sorted(model.items()) for x in kv))
    odds = lambda key: F.coalesce(F.try_element_at(known, key), F.lit(0.0))
    kind = s["kind"].cast("string")
    traits = F.aggregate(F.transform(F.split(s["traits"], ","), lambda x, i: odds(F.concat_ws("/", kind, i, x))), F.lit(0.0), lambda a, b: a + b)
    votes = sum((odds(F.concat_ws("/", kind, F.lit(f"v{k}"), F.substring(s["votes"], k + 1, 1))) for k in range(LABELERS)), F.lit(0.0))
    sound = (s["kind"] == KINDS.index("secret")) | (F.substring(s["votes"], 2, 1) == "1")
    return s["base"] | (sound & (odds(kind) + traits + votes > 0))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _decided(docs: DataFrame, text: str, keep: list[str] | None, with_text: bool) -> DataFrame:
    """(_row, _text if wanted, _spans): candidates are made once and written, the classifier is fitted on all of them."""
    candidates = spotted(docs, text, keep)
    candidates = written(candidates if with_text else candidates.drop("_text"))
    model = fitted(candidates.select("_spans"))
    return candidates.withColumn("_spans", F.array_sort(F.filter("_spans", lambda s: _accepted(s, model))))


def decided(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all if not said) and _spans: the spans that stay, by start, then kind.

    Null or empty text: none. Repeated rows are handled alike; ties in start are in the order of KINDS. Texts of any length: starts are sums
    of the lengths of what lies between matches, so no text is walked once for each match. An input column named _spans gives way to the
    result. An empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "_spans"]
    d = _decided(docs, text, keep or None, False)
    return d.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), "_spans")


#: Code points of the pieces in which a text is cut for replacing, so that a span's place is found without a walk from the text's start.
PIECE = 4096


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets; overlapping spans by one, of the first's kind. n_chars follows.

    Null and empty texts stay as they are, and so do all other columns, whatever they are named; repeated rows are handled alike. A text is
    cut into pieces once, so the time grows with its length and not with the number of spans times the length. An empty table stays empty.
    """
    d = _decided(docs, text, None, True)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.expr("struct(cast(array() as array<struct<start:bigint,kind:int,end:bigint>>) as done, cast(-1 as bigint) as upto)")
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def merge(acc, s):
        last = F.element_at(acc["done"], -1)
        wider = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))))
        done = F.when(s["start"] < acc["upto"], wider).otherwise(F.concat(acc["done"], F.array(plain(s))))
        return F.struct(done.alias("done"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    some = F.size("_spans") > 0
    d = d.withColumn("_merged", F.when(some, F.aggregate("_spans", start, merge)["done"]))
    d = d.withColumn("_pieces", F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    m, pieces = F.col("_merged"), F.col("_pieces")

    def cut(a: Column, b: Column) -> Column:
        """Code points a to b of the text."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        head = F.substring(F.get(pieces, first), (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))
        far = F.concat(F.substring(F.get(pieces, first), (a - first * PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(pieces, last), F.lit(1), (b - last * PIECE).cast("int")))
        return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(far)

    def piece(s, i):
        return F.concat(cut(F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0).cast("long")), s["start"]), F.get(names, s["kind"]))

    tail = cut(F.element_at(m, -1)["end"], F.length("_text").cast("long"))
    # size(pieces) is named so that the optimiser makes the pieces once, outside the lambdas
    d = d.withColumn("_new", F.when(some & (F.size(pieces) > 0) & (F.size(m) > 0), F.concat(F.array_join(F.transform(m, piece), ""), tail)))
    kinds = dict(docs.dtypes)
    changed = {text: F.coalesce("_new", F.col(f"_row.`{text}`"))}
    if "n_chars" in kinds:
        changed["n_chars"] = F.when(some, F.length("_new")).otherwise(F.col("_row.n_chars")).cast(kinds["n_chars"])
    return d.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data. Base spans as the contract's patterns give them; spans and n_added also hold what the method adds:
    spelled-out addresses, phone numbers without +, and secrets. Null text: no span; repeated rows: a row each; long texts: whole."""
    d = decided(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("_spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    sizes = [F.size("_spans").cast("long").alias("n_spans"), F.size(F.filter("_spans", lambda s: ~s["base"])).cast("long").alias("n_added")]
    return d.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"), *sizes)
