"""Arrays, maps and structs of the data sets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def choice_by_letter(options: Column | str, letter: Column | str) -> Column:
    """The option a letter from A to D names; null for another letter or a missing option."""
    at = F.instr(F.lit("ABCD"), _c(letter))
    return F.when((F.length(_c(letter)) == 1) & (at > 0), F.get(_c(options), at - 1))


def choice_by_index(options: Column | str, index: Column | str) -> Column:
    return F.when(_c(index) >= 0, F.get(_c(options), _c(index)))


def triple_text(coref: Column | str, raw: Column | str, most: int = 15) -> Column:
    """The first triples as `s | r | o`, separated by ` ; `; the resolved ones if there are any, else the raw ones."""
    none = F.array().cast("array<struct<s:string,r:string,o:string>>")
    triples = F.when(F.size(_c(coref)) > 0, _c(coref)).when(F.size(_c(raw)) > 0, _c(raw)).otherwise(none)
    return F.array_join(F.transform(F.slice(triples, 1, most), lambda t: F.concat_ws(" | ", t["s"], t["r"], t["o"])), " ; ")


def linearized(triples: Column | str, level: Column | str) -> Column:
    """`generate question level=L: s | r | o . s | r | o`."""
    rows = F.array_join(F.transform(_c(triples), lambda t: F.concat_ws(" | ", t["s"], t["r"], t["o"])), " . ")
    return F.concat(F.lit("generate question level="), _c(level), F.lit(": "), rows)


def gold_passage(context: Column | str, facts: Column | str) -> Column:
    """The sentences of the paragraphs whose title the supporting facts name, in the order of the context."""
    c, f = _c(context), _c(facts)
    pairs = F.filter(F.arrays_zip(c["title"], c["sentences"]), lambda p: F.array_contains(f["title"], p["title"]))
    return F.array_join(F.transform(pairs, lambda p: F.trim(F.array_join(p["sentences"], " "))), " ")


def focus_span(context: Column | str, facts: Column | str) -> Column:
    """The supporting sentences themselves, in the order of the context."""
    c, f = _c(context), _c(facts)
    wanted = F.arrays_zip(f["title"], f["sent_id"])
    spans = F.transform(
        F.arrays_zip(c["title"], c["sentences"]),
        lambda p: F.filter(p["sentences"], lambda _, i: F.exists(wanted, lambda w: (w["title"] == p["title"]) & (w["sent_id"] == i))),
    )
    return F.array_join(F.transform(F.flatten(spans), lambda s: F.trim(s)), " ")


def full_context(context: Column | str) -> Column:
    return F.array_join(F.flatten(_c(context)["sentences"]), " ")


def evidence(sents: Column, used: Column | str) -> Column:
    """The sentences with the given numbers, those out of range left out."""
    inside = F.filter(_c(used), lambda i: (i >= 0) & (i < F.size(sents)))
    return F.array_join(F.transform(inside, lambda i: F.get(sents, i)), " ")


def map_upsert(m: Column | str, key: Column | str, value: Column) -> Column:
    """The map with the key's value set, whether or not it was there; a null map counts as empty."""
    k = F.lit(key) if isinstance(key, str) else key
    rest = F.map_filter(_c(m), lambda x, _: x != k)
    new = F.create_map(k, value)
    return F.when(_c(m).isNull(), new).otherwise(F.map_concat(rest, new))


def first_value(m: Column | str) -> Column:
    """The value of the smallest key."""
    return F.try_element_at(_c(m), F.get(F.array_sort(F.map_keys(_c(m))), 0))


def feature_map(feats: Column | str) -> Column:
    """`A=B|C=D` as a map."""
    return F.str_to_map(_c(feats), F.lit(r"\|"), F.lit("="))


def answer_covered(triples: Column | str, answer: Column | str) -> Column:
    """Whether the answer stands in the subject or object of any triple."""
    a = F.lower(_c(answer))
    return F.exists(_c(triples), lambda t: F.contains(F.lower(t["s"]), a) | F.contains(F.lower(t["o"]), a))


def sentence_window(sents: Column, at: Column | str, window: int = 1) -> Column:
    """The sentence that holds a character offset of the joined sentences, with its neighbours on both sides."""
    ends = F.transform(sents, lambda _, i: F.aggregate(F.slice(sents, 1, i + 1), F.lit(0), lambda n, s: n + F.length(s) + 1))
    hit = F.size(F.filter(ends, lambda e: e <= _c(at)))
    hit = F.least(hit, F.size(sents) - 1)
    start = F.greatest(F.lit(0), hit - window)
    return F.array_join(F.slice(sents, start + 1, hit + window + 1 - start), " ")
