"""Column functions: sequences, identifiers, categories."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length bins, fixed values: label, first, last.
BINS = (("50-100", 50, 100), ("101-200", 101, 200), ("201-300", 201, 300), ("301-500", 301, 500), ("501-800", 501, 800), (">800", 801, None))
CATEGORIES = ("Verified", "Uncharacterized", "Dubious")


def seq_upper(seq: Column) -> Column:
    return F.upper(seq)


def reverse_complement(seq: Column) -> Column:
    """ACGT complemented, other letters kept, order reversed; upper case."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def codon_split(seq: Column, frame: Column | int = 0) -> Column:
    """Array of the whole codons from `frame`; the rest under three letters is dropped. Linear in the length."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.regexp_extract_all(F.substring(F.upper(seq), (frame + 1).cast("int"), F.length(seq)), F.lit("(?s)..."), F.lit(0))


def subsequence(seq: Column, start: Column, end: Column, pad: int = 0) -> Column:
    """1-based inclusive slice, widened by pad on both sides and cut at the sequence's ends."""
    first = F.greatest(start - pad, F.lit(1))
    last = F.least(end + pad, F.length(seq))
    return F.substring(seq, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))


def delete_base(seq: Column) -> Column:
    """The letter at half of the length (0-based) taken out: a frameshift."""
    h = F.floor(F.length(seq) / 2).cast("int")
    return F.concat(F.substring(seq, F.lit(1), h), F.substring(seq, h + 2, F.length(seq)))


def log2_floor(v: Column, floor: float = -10.0) -> Column:
    """log2; zero becomes `floor`, a negative number NaN."""
    return F.when(v == 0, F.lit(floor)).when(v < 0, F.lit(float("nan"))).otherwise(F.log2(v))


def exp2(v: Column) -> Column:
    return F.pow(F.lit(2.0), v)


def assign_bin(length: Column) -> Column:
    out = F.lit(">800")
    for label, low, high in reversed(BINS[:-1]):
        out = F.when(length.between(low, high), label).otherwise(out)
    return out


def extract_id(name: Column) -> Column:
    """The identifier in a prediction file's name, known suffixes taken off."""
    return F.regexp_replace(name, r"(_summary_confidences|_confidences|_model|_data)?(\.cif)?(\.[^.]+)?$", "")


def normalize_parent(parent: Column) -> Column:
    """Gene of a CDS parent: before _mRNA; else the first of a list before _id; else as it is."""
    return F.when(F.contains(parent, F.lit("_mRNA")), F.split_part(parent, F.lit("_mRNA"), F.lit(1))).when(F.contains(parent, F.lit("_id")), F.split_part(F.split_part(parent, F.lit(","), F.lit(1)), F.lit("_id"), F.lit(1))).otherwise(parent)


def has_introns(n_exons: Column) -> Column:
    return F.when(n_exons > 1, "yes").otherwise("no")


def description(category: Column, n_exons: Column, length: Column, chromosome: Column) -> Column:
    return F.concat_ws(" | ", category, F.concat(n_exons.cast("string"), F.lit(" exons")), F.concat(length.cast("string"), F.lit(" AA")), chromosome)


def category_of(header: Column) -> Column:
    out = F.lit("Unknown")
    for c in reversed(CATEGORIES):
        out = F.when(F.contains(header, F.lit(c)), c).otherwise(out)
    return out


def chromosome_of(header: Column) -> Column:
    return F.regexp_extract(header, r", Chr (\S+)", 1)


def region_header(name: Column, pad: Column | int, start: Column, end: Column, strand: Column) -> Column:
    """FASTA header of a padded region; the location is the padded one."""
    pad = F.lit(pad) if isinstance(pad, int) else pad
    return F.concat(F.lit(">"), name, F.lit(" padding="), pad.cast("string"), F.lit(" padded_loc=["), (start - pad).cast("string"), F.lit(","), (end + pad).cast("string"), F.lit("] strand="), strand)


def uid() -> Column:
    return F.substring(F.expr("uuid()"), 1, 8)


def stamp(at: Column) -> Column:
    """A time as matrices carry it."""
    return F.date_format(at, "yyyy-MM-dd HHmmss")


def now() -> Column:
    return stamp(F.current_timestamp())


def shortest(x: Column) -> Column:
    """x (a double) as Python prints it: the shortest digits that give it back, with an exponent only under 1e-4 and from 1e16 on."""
    v = x.cast("double")
    t, size = v.cast("string"), F.abs(v)
    plain = F.regexp_replace(v.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_extract(t, r"E-?(\d+)$", 1)
    scaled = F.concat(F.regexp_extract(t, r"^(-?\d+(?:\.(?!0E)\d+)?)", 1), F.when(F.contains(t, F.lit("E-")), "e-").otherwise("e+"), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    named = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.coalesce(named, F.when(~F.contains(t, F.lit("E")), t).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scaled))


#: 2**0 to 2**126, the powers that a decimal of 38 digits holds.
_POWERS = 127
_WHOLE = "decimal(38,0)"


def _let(x: Column, use) -> Column:
    """use(x), x evaluated once: a lambda's variable stands for it, so expressions stay small."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def fixed(x: Column, decimals: int, width: int = 0) -> Column:
    """x (a double) with that many decimals (12 at most), rounded half to even on its exact binary value, as C and Python print it;
    padded on the left to the width. nan, inf and -inf as such; from 2**126 on the digits after the 17th are zeros.

    x is m / 2**s with a whole m of at most 62 bits, so m * 10**decimals and 2**s are exact decimals, and so are quotient and remainder.
    """
    if not 0 <= decimals <= 12:
        raise ValueError("0 to 12 decimals")
    number = lambda n: F.lit(Decimal(n)).cast(_WHOLE)
    powers = F.array(*(number(1 << k) for k in range(_POWERS)))
    zeros = "." + "0" * decimals if decimals else ""

    def point(t: Column) -> Column:
        """The digits of a whole number of 10 ** -decimals."""
        if not decimals:
            return t
        return _let(F.when(F.length(t) <= decimals, F.lpad(t, decimals + 1, "0")).otherwise(t), lambda d: F.concat(F.left(d, F.length(d) - decimals), F.lit("."), F.right(d, F.lit(decimals))))

    def rounded(n: Column, s: Column) -> Column:
        """n / 2 ** s, half to even: s over 0."""
        parts = lambda unit: F.struct((n % unit).alias("rest"), ((n - n % unit) / unit).cast(_WHOLE).alias("q"), F.get(powers, s - 1).alias("half"))
        up = lambda r: (r["rest"] > r["half"]) | ((r["rest"] == r["half"]) & (r["q"] % 2 == 1))
        return _let(_let(F.get(powers, s), parts), lambda r: (r["q"] + F.when(up(r), number(1)).otherwise(number(0))).cast(_WHOLE))

    def digits(v: Column) -> Column:
        """Of a finite number, without its sign."""
        s = F.when(v["size"] > 0, 60 - F.floor(F.log2(v["size"])).cast("int")).otherwise(_POWERS)
        exact = lambda k: F.struct(k.alias("s"), F.when(k < _POWERS, v["size"] * F.pow(F.lit(2.0), k)).cast("long").cast("decimal(19,0)").alias("m"))
        small = lambda e: point(rounded((e["m"] * F.lit(Decimal(10**decimals)).cast(f"decimal({decimals + 1},0)")).cast(_WHOLE), e["s"]).cast("string"))
        large = lambda e: F.concat((e["m"] * F.get(powers, -e["s"])).cast(_WHOLE).cast("string"), F.lit(zeros))
        nothing = point(F.lit("0"))
        kinds = lambda e: F.when(e["s"] >= _POWERS, nothing).when(e["s"] > 0, small(e)).when(e["s"] > -66, large(e)).otherwise(F.format_string(f"%.{decimals}f", v["size"]))
        return _let(_let(s, exact), kinds)

    def text(v: Column) -> Column:
        # a result of 15 digits at most: the shortest decimal rounds as the double does, but where it ends just between two results
        plain = F.format_string(f"%.{decimals}f", v["v"])
        sign = F.when((v["v"] < 0) | (v["t"] == "-0.0"), "-").otherwise("")
        named = F.when(F.isnan(v["v"]), "nan").when(v["size"] == float("inf"), F.concat(sign, F.lit("inf")))
        return F.when((v["size"] < 10.0 ** (15 - decimals)) & ~v["t"].rlike(rf"[EIN]|\.{'5' if not decimals else f'[0-9]{{{decimals}}}5'}$"), plain).otherwise(F.coalesce(named, F.concat(sign, digits(v))))

    v = x.cast("double")
    out = F.when(v.isNotNull(), _let(F.struct(v.alias("v"), F.abs(v).alias("size"), v.cast("string").alias("t")), text))
    return F.lpad(out, F.greatest(F.length(out), F.lit(width)), F.lit(" ")) if width else out
