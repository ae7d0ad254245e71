"""Splits that keep related records together (problem 5).

Records that share a passage or an author, directly or through other records, form one group, and a group lands in one
split. Groups are the connected components of a graph between passages and authors, found by random-mate contraction:
each round every vertex draws a coin, each tail with a head among its neighbours is collapsed into one of them, and the
edges are renamed, until none is left; the collapses are then unwound from the last to the first. All of it is joins and
aggregations over tables of the shared folder, so a lost executor costs no more than the stage it was in.

Defined results: a record without passage and author (null, blank, or a word standing for nobody) is a group of its own.
Rows with a null id are left out. Repeated rows of one id count once; where they differ, each adds its links.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readq.functions.text import canonical_text, let
from readq.llm.memo import Memo
from readq.operators.ordered import prefix_sum
from readq.session import materialise

#: So many splits may be wanted.
MAX_SPLITS = 1000
#: Words that stand for nobody, as the author key writes them (names sorted, lower case).
NOBODY = (
    "", "anonymous", "anon", "author unknown", "unknown", "staff", "staff writer", "staff writers", "editorial staff", "editorial team",
    "editor", "editors", "the editors", "admin", "administrator", "a n", "na", "n a", "none", "null", "nil", "nobody", "no author", "not available",
    "not given", "not known", "not stated", "author", "authors", "various", "authors various", "various writers", "misc", "several", "et al",
    "others", "unnamed", "no name", "noname", "name no", "tba", "tbd", "user", "guest", "writer", "writer unknown", "collective", "team",
    "team writing", "contributor", "contributors", "unspecified", "author no", "author not known", "known not", "given not", "available not",
)


def author_key(col: Column | str, nobody: tuple[str, ...] = NOBODY) -> Column:
    """The author's names sorted, without case and punctuation, hashed; null for null and for words standing for nobody."""
    col = F.col(col) if isinstance(col, str) else col
    plain = F.regexp_replace(F.lower(col), r"[\p{Cf}'’.]+", "")
    names = F.array_sort(F.array_remove(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+", " "), " "), ""))
    return let(F.array_join(names, " "), lambda t: F.when(~t.isin(*nobody), F.md5(t)))


def record_keys(df: DataFrame, id_col: str, passage_col: str, author_col: str, nobody: tuple[str, ...] = NOBODY) -> DataFrame:
    """(rec, p, a): each row's id with the keys of its passage and author. A passage met again in a task is not worked on again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo()
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                if text is None or text in known:
                    keys.append(known.get(text))
                    continue
                plain = canonical_text(text)
                known[text] = key = hashlib.md5(plain.encode()).digest() if plain else None
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(2)], ["rec", "p", "a"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("rec"), F.col(passage_col).cast("string").alias("text"), author_key(author_col, nobody).alias("a"))
    return rows.mapInArrow(read, "rec BIGINT, p BINARY, a STRING")


def contract(edges: DataFrame, seed: int = 11, rounds: int = 200) -> DataFrame:
    """Vertices (v) of an undirected graph of edges (u, v: BIGINT) that were collapsed, each with the root (rep) of its component.

    A component's root itself is not among the rows. Coins come from a hash of seed, round and vertex, so a task that runs
    twice draws the same coins. Each round at least a quarter of the vertices with edges is expected to vanish.
    """
    live = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = materialise(live, "edges")
    maps: list[DataFrame] = []
    for k in range(rounds):
        if live.isEmpty():
            break
        heads = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), c), F.lit(2)) == 1  # noqa: B023, E731
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        collapse = both.where(~heads(F.col("u")) & heads(F.col("v"))).groupBy(F.col("u").alias("v")).agg(F.min("v").alias("rep"))
        collapse = materialise(collapse, f"collapse{k}")
        maps.append(collapse)
        at_u, at_v = (collapse.select(F.col("v").alias(c), F.col("rep").alias(f"new_{c}")) for c in "uv")
        renamed = live.join(at_u, "u", "left").join(at_v, "v", "left").select(F.coalesce("new_u", "u").alias("u"), F.coalesce("new_v", "v").alias("v"))
        renamed = renamed.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        live = materialise(renamed, f"edges{k}")
    else:
        if not live.isEmpty():
            raise RuntimeError(f"edges are left after {rounds} rounds")
    if not maps:
        return live.select("v", F.col("u").alias("rep"))
    # Unwind: every vertex was collapsed once, into one that was collapsed later or never. Following the collapses, each time
    # twice as far, reaches the root after as many steps as the number of rounds has binary digits.
    labels = materialise(reduce(DataFrame.unionByName, maps), "labels")
    for k in range(len(maps).bit_length()):
        further = labels.select(F.col("v").alias("rep"), F.col("rep").alias("next"))
        labels = materialise(labels.join(further, "rep", "left").select("v", F.coalesce("next", "rep").alias("rep")), f"labels{k}")
    return labels


def linked_groups(df: DataFrame, id_col: str = "rec_id", passage_col: str = "passage", author_col: str = "author", nobody: tuple[str, ...] = NOBODY) -> DataFrame:
    """Each record's id with the smallest id of its group: (group_id, rec_id)."""
    keys = materialise(record_keys(df, id_col, passage_col, author_col, nobody), "keys")
    pairs = keys.groupBy("p", "a").agg(F.min("rec").alias("m")).where(F.col("p").isNotNull() | F.col("a").isNotNull())
    pairs = materialise(pairs, "pairs")
    # A vertex is named by its smallest record: even numbers are passages, odd ones authors, records with several keys link them.
    passages = pairs.where("p IS NOT NULL").groupBy("p").agg((F.min("m") * 2).alias("pv"))
    authors = pairs.where("a IS NOT NULL").groupBy("a").agg((F.min("m") * 2 + 1).alias("av"))
    named = materialise(pairs.join(passages, "p", "left").join(authors, "a", "left"), "named")
    # One record id may have come with different keys; a chain through it is a link as well.
    pair = F.struct("p", "a")  # its order puts nulls first and leaves none out
    several = keys.groupBy("rec").agg(F.min(pair).alias("x"), F.max(pair).alias("y")).where(~F.col("x").eqNullSafe(F.col("y"))).select("rec")
    extra = keys.join(several, "rec", "left_semi").join(passages, "p", "left").join(authors, "a", "left")
    first = extra.groupBy("rec").agg(F.min(F.coalesce("pv", "av")).alias("first"))
    extra = extra.join(first, "rec").select(F.col("first").alias("u"), F.explode(F.array("pv", "av")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    roots = contract(named.where("pv IS NOT NULL AND av IS NOT NULL").select(F.col("pv").alias("u"), F.col("av").alias("v")).unionByName(extra))
    rooted = named.withColumn("v", F.coalesce("pv", "av")).join(roots, "v", "left").select("p", "a", "m", F.coalesce("rep", "v").alias("root"))
    rooted = materialise(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("m").alias("group_id"))
    of_pair = rooted.join(smallest, "root").select("p", "a", "group_id")
    linked = F.col("p").isNotNull() | F.col("a").isNotNull()
    found = keys.where(linked).join(of_pair, keys["p"].eqNullSafe(of_pair["p"]) & keys["a"].eqNullSafe(of_pair["a"])).select("group_id", F.col("rec").alias("rec_id"))
    # Records without passage and author would all meet at one key; they are groups of their own.
    alone = keys.where(~linked).select(F.col("rec").alias("group_id"), F.col("rec").alias("rec_id"))
    return found.unionByName(alone).groupBy("rec_id").agg(F.min("group_id").alias("group_id")).select("group_id", "rec_id")


def split_groups(groups: DataFrame, shares: DataFrame, seed: int = 11) -> DataFrame:
    """A split for each record of (group_id, rec_id): groups in order of falling size (ties by a seeded hash) are laid end to
    end, and a group gets the split whose stretch of the total weight holds the group's middle. Every record of a group gets
    the same one. shares: (split, share); shares count relative to their sum; null or non-positive shares get nothing.
    """
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    # The order by name within the largest share first keeps a giant group in the largest split.
    laid = prefix_sum(sizes, [F.col("size").desc(), F.xxhash64(F.lit(seed), F.col("group_id")), F.col("group_id")], F.col("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 1
    wanted = shares.where("share > 0 AND split IS NOT NULL").groupBy("split").agg(F.sum("share").alias("share")).orderBy(F.desc("share"), "split").limit(MAX_SPLITS + 1).collect()
    if not 0 < len(wanted) <= MAX_SPLITS:
        raise ValueError(f"1 to {MAX_SPLITS} splits are wanted")
    middle, end, split = (F.col("before") + F.col("size") / 2) / total, 0.0, F.lit(wanted[-1]["split"])
    ends = []
    for r in wanted:
        end += r["share"] / sum(x["share"] for x in wanted)
        ends.append((end, r["split"]))
    for end, name in reversed(ends[:-1]):
        split = F.when(middle < end, name).otherwise(split)
    chosen = laid
    return groups.join(chosen.select("group_id", split.alias("split")), "group_id").select("rec_id", "group_id", "split")
