"""Difficulty of questions by rules: four scores from 0 to 1, and the level of their mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readq.functions import text as T

# The base score of each question kind, and what more hops add to a chain.
TYPE_SCORES = {
    "true_claim": 0.20,
    "false_claim": 0.20,
    "object": 0.20,
    "subject": 0.20,
    "comparison": 0.25,
    "which": 0.25,
    "aggregation": 0.37,
    "count": 0.25,
    "subgraph": 0.30,
    "chain_subgraph": 0.40,
    "chain": 0.35,
    "bridge": 0.30,
}
HOP_BONUS = {1: 0.0, 2: 0.0, 3: 0.20, 4: 0.30}
FAR_BONUS = 0.40
# The weights of a question's reasoning demand.
WEIGHTS = {"qtype": 0.45, "coref": 0.30, "coverage": 0.15, "density": 0.10}

# The pronouns that make a reader look back.
PRONOUNS = (
    "i", "me", "my", "we", "our", "us",
    "he", "him", "his", "she", "her",
    "it", "its", "they", "them", "their",
    "this", "that", "these", "those",
)


def type_score(kind: Column, hops: Column) -> Column:
    base = F.lit(0.20)
    for name, value in TYPE_SCORES.items():
        base = F.when(kind == name, value).otherwise(base)
    bonus = F.lit(FAR_BONUS)
    for n, value in HOP_BONUS.items():
        bonus = F.when(hops == n, value).otherwise(bonus)
    return F.least(base + F.when(kind == "chain", bonus).otherwise(0.0), F.lit(1.0))


def local_score(source_depth: Column, answer_depth: Column, coref_distance: Column) -> Column:
    """Mean of the clause depth, the answer's depth and the distance to the name, each from 0 to 1."""
    return (F.least(source_depth, F.lit(3)) / 3 + F.least(F.greatest(answer_depth - 1, F.lit(0)), F.lit(2)) / 2 + F.least(coref_distance, F.lit(3)) / 3) / 3


def vocab_score(is_passive: Column, kind: Column) -> Column:
    return F.least(0.5 * is_passive.cast("int") + 0.5 * (kind == "chain").cast("int"), F.lit(1.0))


def level(s_type: Column, s_local: Column, s_vocab: Column, s_read: Column) -> Column:
    return T.level_of((s_type + s_local + s_vocab + s_read) / 4)


def passage_level(passage: Column | str) -> Column:
    """The level of a passage alone: kind and locality 0.2 each, no vocabulary, readability by the LIX."""
    return T.level_of((0.4 + T.lix(passage)) / 4)


def reasoning_demand(question: Column | str, answer: Column | str, raw: Column | str, coref: Column | str) -> Column:
    """From 0 to 1: the question's beginning, the share of the answer's triples that speak of it by pronoun, whether no triple
    holds the answer, and how many triples there are."""
    q, a, r, c = (F.col(x) if isinstance(x, str) else x for x in (question, answer, raw, coref))
    r = F.coalesce(r, F.array().cast("array<struct<s:string,r:string,o:string>>"))
    low = F.lower(a)
    covering = F.filter(r, lambda t: F.contains(F.lower(t["s"]), low) | F.contains(F.lower(t["o"]), low))

    def total(x: Column) -> Column:
        spoken = F.filter(x["c"], lambda t: F.lower(t["s"]).isin(*PRONOUNS) | F.lower(t["o"]).isin(*PRONOUNS))
        s_coref = F.when((F.coalesce(F.size(c), F.lit(0)) <= 0) | (x["r"] == c) | (F.size(x["c"]) == 0), 0.0).otherwise(F.size(spoken) / F.size(x["c"]))
        s_cover = F.when(F.size(x["c"]) > 0, 0.0).otherwise(1.0)
        s_dense = F.least(F.size(x["r"]) / 15.0, F.lit(1.0))
        return F.least(WEIGHTS["qtype"] * T.qtype_score(q) + WEIGHTS["coref"] * s_coref + WEIGHTS["coverage"] * s_cover + WEIGHTS["density"] * s_dense, F.lit(1.0))

    return T.let(F.struct(covering.alias("c"), r.alias("r")), total)
