"""Hash buckets, similarity and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def md5_mod(col: Column | str, m: int) -> Column:
    """The MD5 of the text, read as one 128-bit number, modulo m: eight hex digits at a time, as no type holds the whole."""
    digest, step = F.md5(_c(col)), 2**32 % m
    rest = F.lit(0).cast("bigint")
    for k in range(4):
        rest = (rest * step + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")) % m
    return rest


def hash_split(col: Column | str, train: float = 0.8, val: float = 0.1, test: float | None = None) -> Column:
    """train, val or test by the text's bucket among 100. test: what the others leave, if not given; the three sum to 1 within 0.01."""
    test = 1 - train - val if test is None else test
    if min(train, val) < 0 or test < -0.01 or abs(train + val + test - 1) > 0.01:
        raise ValueError("three shares that are not negative and sum to 1 are wanted")
    bucket = md5_mod(col, 100)
    return F.when(bucket < train * 100, "train").when(bucket < (train + val) * 100, "val").when(bucket.isNotNull(), "test")


def train_eval_split(col: Column | str) -> Column:
    """train for eight of ten buckets, else eval."""
    return F.when(md5_mod(col, 10) < 8, "train").when(_c(col).isNotNull(), "eval")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalised(a: Column | str) -> Column:
    """The vector at length 1; one without length stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def triplet_loss(anchor: Column | str, positive: Column | str, negative: Column | str, margin: float = 0.5) -> Column:
    """max(d(anchor, positive) - d(anchor, negative) + margin, 0) with cosine distances."""
    return F.greatest(cosine(anchor, negative) - cosine(anchor, positive) + margin, F.lit(0.0))


def has_nan(a: Column | str) -> Column:
    return F.exists(_c(a), lambda x: F.isnan(x))


def token_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two token lists: different common tokens against the lengths of the lists with repeats."""
    common = F.size(F.array_intersect(predicted, truth))
    p, r = common / F.size(predicted), common / F.size(truth)
    return F.when((F.size(predicted) == 0) | (F.size(truth) == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def frequency_band(freq: Column | str, lang: str = "en") -> Column:
    """A1 (commonest) to C2 by a word's frequency; null for frequency 0 or null."""
    # Lower ends of the bands.
    ends = {"en": {"A1": 0.001, "A2": 0.0003, "B1": 0.0001, "B2": 0.00003, "C1": 0.000008}, "fi": {"A1": 0.1, "A2": 0.03, "B1": 0.01, "B2": 0.003, "C1": 0.0008}}[lang]
    out = F.lit("C2")
    for band, least in reversed(ends.items()):
        out = F.when(_c(freq) >= least, band).otherwise(out)
    return F.when(_c(freq) > 0, out)


def round_binary(x: Column, digits: int) -> Column:
    """The double rounded to so many digits as its exact binary value asks for; a true tie goes to the even digit. Spark's own functions
    round the shortest decimal that stands for the double, so 2.675 gives 2.68 there and 2.67 here."""
    scale = float(10**digits)
    p = x * scale
    # The error of the product, exactly: the double in two halves of 26 bits (Veltkamp), times a small whole number.
    wide = x * 134217729.0
    high = wide - (wide - x)
    error = (high * scale - p) + (x - high) * scale
    low = F.floor(p)
    tie = p - low == 0.5
    return F.when(tie & (error > 0), (low + 1) / scale).when(tie & (error < 0), low / scale).otherwise(F.rint(p) / scale)


def argmax(a: Column | str) -> Column:
    """The place, from 0, of the first largest number of an array; null for null and empty arrays."""
    at = F.array_position(_c(a), F.array_max(_c(a)))
    return F.when(F.size(_c(a)) > 0, (at - 1).cast("int"))
