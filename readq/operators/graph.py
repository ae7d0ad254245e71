"""The entity graph of each document: a directed multigraph whose edges are its triples in their order.

A row of the edge table is one triple; a row of the node table is one name within a document. All keys hold the document, so
everything is partitioned by it and by the node, and a document with very many edges is spread over its nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERSON = ("PERSON", "PER")
# The pronouns that mentions are resolved from, in English and Finnish.
PRONOUNS = {"en": ("she", "he", "they", "it", "her", "him", "them", "we"), "fi": ("hän", "he", "se", "me")}


#: Mentions of a document are worked on in chunks of so many places.
CHUNK = 10_000


def valid_triples(triples: DataFrame) -> DataFrame:
    """Triples with a subject, a relation and an object."""
    return triples.where("doc_id IS NOT NULL AND ord IS NOT NULL AND trim(subject) <> '' AND trim(relation) <> '' AND trim(object) <> ''")


def nodes(triples: DataFrame) -> DataFrame:
    """(doc_id, node, entity_type, node_ord): each name once, with the type and the place of its first appearance."""
    at = F.array(
        F.struct(F.col("subject").alias("node"), F.col("subject_type").alias("t"), (F.col("ord") * 2).cast("bigint").alias("pos")),
        F.struct(F.col("object").alias("node"), F.col("object_type").alias("t"), (F.col("ord") * 2 + 1).cast("bigint").alias("pos")),
    )
    seen = valid_triples(triples).select("doc_id", F.explode(at).alias("x")).select("doc_id", "x.*")
    return seen.groupBy("doc_id", "node").agg(F.min_by("t", "pos").alias("entity_type"), F.min("pos").alias("node_ord"))


def edges(triples: DataFrame) -> DataFrame:
    """(doc_id, ord, src, dst, relation, source, src_type, dst_type, edge_ord): edge_ord is the place among the document's edges when they
    are walked source by source in order of appearance, and target by target in order of the first edge to it."""
    n = nodes(triples)
    e = valid_triples(triples).select("doc_id", "ord", F.col("subject").alias("src"), F.col("object").alias("dst"), "relation", "source")
    s = n.select("doc_id", F.col("node").alias("src"), F.col("entity_type").alias("src_type"), F.col("node_ord").alias("src_ord"))
    d = n.select("doc_id", F.col("node").alias("dst"), F.col("entity_type").alias("dst_type"))
    first = F.min("ord").over(Window.partitionBy("doc_id", "src", "dst"))
    rows = e.join(s, ["doc_id", "src"]).join(d, ["doc_id", "dst"]).withColumn("edge_ord", F.struct("src_ord", first.alias("first"), "ord"))
    return rows.select("doc_id", "ord", "src", "dst", "relation", "source", "src_type", "dst_type", "edge_ord")


def degrees(triples: DataFrame) -> DataFrame:
    """(doc_id, node, degree): edges that begin or end at the node; a loop counts twice."""
    e = valid_triples(triples).select("doc_id", F.explode(F.array("subject", "object")).alias("node"))
    return e.groupBy("doc_id", "node").agg(F.count("*").alias("degree"))


def neighbours(triples: DataFrame) -> DataFrame:
    """(doc_id, node, neighbour): different targets of each node's edges."""
    return valid_triples(triples).select("doc_id", F.col("subject").alias("node"), F.col("object").alias("neighbour")).distinct()


def summary(triples: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, n_edges)."""
    e = valid_triples(triples).groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    return nodes(triples).groupBy("doc_id").agg(F.count("*").alias("n_nodes")).join(e, "doc_id")


def paths(edge_table: DataFrame, hops: int) -> DataFrame:
    """(doc_id, path, relations, n_hops): every path of one to `hops` edges without a repeated node, once for each choice of parallel
    edges. Each hop is one join on (document, end of the path)."""
    e = edge_table.select("doc_id", "src", "dst", "relation", "ord")
    one = e.where("src <> dst").select("doc_id", F.array("src", "dst").alias("path"), F.array("relation").alias("relations"), F.array("ord").alias("ords"), F.col("dst").alias("end"))
    step, found = one, [one]
    for _ in range(hops - 1):
        nxt = e.select("doc_id", F.col("src").alias("end"), F.col("dst").alias("to"), F.col("relation").alias("r"), F.col("ord").alias("o"))
        joined = step.join(nxt, ["doc_id", "end"]).where(~F.array_contains("path", F.col("to")))
        step = joined.select("doc_id", F.array_append("path", F.col("to")).alias("path"), F.array_append("relations", F.col("r")).alias("relations"), F.array_append("ords", F.col("o")).alias("ords"), F.col("to").alias("end"))
        found.append(step)
    return reduce(DataFrame.unionByName, found).select("doc_id", "path", "relations", "ords", F.size("relations").cast("bigint").alias("n_hops"))


def siblings(edge_table: DataFrame, by: str = "dst_type") -> DataFrame:
    """(doc_id, src, relation, type, n, members): targets of one type that a source reaches by one relation, at least two different ones."""
    rows = edge_table.where(F.col(by).isNotNull()).groupBy("doc_id", "src", "relation", F.col(by).alias("type"), "dst").agg(F.min("edge_ord").alias("o"))
    got = rows.groupBy("doc_id", "src", "relation", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o", "dst"))).alias("m"))
    return got.where("n >= 2").select("doc_id", "src", "relation", "type", "n", F.transform("m", lambda x: x["dst"]).alias("members"))


def earlier_max(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The rows with `value` replaced by the largest value of the key's rows that come earlier in the order, null without any.

    A key's rows are cut by the order into chunks, which are tasks of their own; the largest value of each chunk, one row, is
    carried on to the later ones. So a document with very many mentions is no large task.
    """
    cut = rows.withColumn("__chunk", F.floor(F.col(order) / CHUNK))
    ahead = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "__chunk").agg(F.max(value).alias("__top")).withColumn("__top", F.max("__top").over(ahead))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn(value, F.max(value).over(inside)).join(carried, [*keys, "__chunk"])
    return out.withColumn(value, F.greatest(value, "__top")).select(*rows.columns)


def resolve_mentions(triples: DataFrame, pronouns: tuple[str, ...] = PRONOUNS["en"]) -> DataFrame:
    """The triples with pronouns and last names replaced by names that appeared earlier in the document, and the distance in
    sentences to them (the larger of both ends; 0 if nothing was replaced).

    A single word of a type becomes the longest earlier name of several words with that last word and type; a pronoun becomes the
    person that was introduced last before the triple. Both are windows over the document's mentions in order:
    first the names of several words, then the single words that none of them explains, which are names as well.
    """
    t = valid_triples(triples)
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.col("subject").alias("name"), F.col("subject_type").alias("type")),
        F.struct(F.lit(1).alias("side"), F.col("object").alias("name"), F.col("object_type").alias("type")),
    )
    m = t.select("doc_id", "ord", "sentence_idx", F.explode(both).alias("x")).select("doc_id", "ord", "sentence_idx", "x.*", (F.col("ord") * 2 + F.col("x.side")).alias("k"))
    parts = F.split(F.trim("name"), r"\s+")
    m = m.withColumns({"pronoun": F.lower("name").isin(*pronouns), "n": F.size(parts), "last": F.lower(F.element_at(parts, -1))})
    # A name's introduction: its first mention with a type.
    full = m.where("n > 1 AND type IS NOT NULL AND NOT pronoun")
    intro = full.groupBy("doc_id", "name", "type", "last").agg(F.min(F.struct("k", "ord", "sentence_idx")).alias("f")).select("doc_id", "name", "type", "last", "f.*")
    # Of single words: the longest earlier name, then the earliest, by a running maximum over introductions and words in order.
    marks = intro.select("doc_id", "type", "last", "ord", F.lit(1).alias("intro"), F.struct(F.length("name").alias("len"), (-F.col("k")).alias("nk"), "name", F.col("sentence_idx").alias("s")).alias("best"))
    single = m.where("n = 1 AND type IS NOT NULL AND NOT pronoun")
    empty = F.lit(None).cast("struct<len:int,nk:int,name:string,s:int>")
    asked = single.select("doc_id", "type", "last", "ord", F.lit(0).alias("intro"), empty.alias("best"), "k", "name", "sentence_idx")
    every = marks.withColumns({"best": F.col("best").cast("struct<len:int,nk:int,name:string,s:int>")}).unionByName(asked, allowMissingColumns=True)
    found = earlier_max(every, ["doc_id", "type", "last"], "ord", "best").where("intro = 0").select("doc_id", "k", "name", "type", "ord", "sentence_idx", "best")
    # Persons in order of introduction: names of several words, and single words that nothing explains.
    alone = found.where("best IS NULL").groupBy("doc_id", "name", "type").agg(F.min(F.struct("k", "ord", "sentence_idx")).alias("f")).select("doc_id", "name", "type", "f.*")
    people = intro.select("doc_id", "name", "type", "k", "ord", "sentence_idx").unionByName(alone).where(F.col("type").isin(*PERSON))
    pron = m.where("pronoun").select("doc_id", "ord", F.lit(0).alias("intro"), F.lit(None).cast("struct<k:int,name:string,type:string,s:int>").alias("who"), "k", "sentence_idx")
    intros = people.select("doc_id", "ord", F.lit(1).alias("intro"), F.struct(F.col("k").cast("int").alias("k"), "name", "type", F.col("sentence_idx").cast("int").alias("s")).alias("who"))
    said = earlier_max(intros.unionByName(pron, allowMissingColumns=True), ["doc_id"], "ord", "who").where("intro = 0 AND who IS NOT NULL")
    fixes = found.where("best IS NOT NULL").select("doc_id", "k", F.col("best.name").alias("to"), "type", (F.col("sentence_idx") - F.col("best.s")).alias("distance"))
    fixes = fixes.unionByName(said.select("doc_id", "k", F.col("who.name").alias("to"), F.col("who.type").alias("type"), (F.col("sentence_idx") - F.col("who.s")).alias("distance")))
    s = fixes.where("k % 2 = 0").select("doc_id", F.expr("CAST(k / 2 AS INT)").alias("ord"), F.col("to").alias("s_to"), F.col("type").alias("s_type"), F.col("distance").alias("s_d"))
    o = fixes.where("k % 2 = 1").select("doc_id", F.expr("CAST((k - 1) / 2 AS INT)").alias("ord"), F.col("to").alias("o_to"), F.col("type").alias("o_type"), F.col("distance").alias("o_d"))
    out = t.join(s, ["doc_id", "ord"], "left").join(o, ["doc_id", "ord"], "left")
    zero = F.lit(0)
    return out.withColumns(
        {
            "subject": F.coalesce("s_to", "subject"),
            "object": F.coalesce("o_to", "object"),
            "subject_type": F.coalesce("s_type", "subject_type"),
            "object_type": F.coalesce("o_type", "object_type"),
            "coref_distance": F.greatest(F.coalesce("s_d", zero), F.coalesce("o_d", zero)),
        }
    ).select(*triples.columns)
