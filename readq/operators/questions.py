"""Questions from the triples of each document, by templates.

Every kind of question is a plan over the fact table: filters, joins on (document, node) and groupings, with the text built by
expressions. All kinds give the columns QUESTION; `assemble` puts them together. Nothing is collected, and no kind looks
at more than one document at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readq.functions import text as T
from readq.operators import difficulty as D
from readq.operators import graph as G
from readq.operators import lexicon as L
from readq.session import materialise

#: kind_no is the place of the kind when all are put together; ord the place of the question within its kind.
QUESTION = ("doc_id", "kind", "kind_no", "ord", "text", "answer", "answer_type", "answer_list", "hop_count", "is_passive", "s_type", "s_local", "s_vocab", "fixed_level")
KINDS = ("object", "subject", "aggregation", "true_claim", "false_claim", "which", "count", "comparison", "chain", "subgraph", "pair_subgraph", "chain_subgraph", "bridge")
#: So many names of a type are tried for a false claim before all others are.
FIRST_NAMES = 8
PLACE = {"object": 0, "subject": 0, "aggregation": 0, "true_claim": 1, "false_claim": 1, "which": 2, "count": 3, "comparison": 4, "chain": 5, "subgraph": 6, "pair_subgraph": 7, "chain_subgraph": 8, "bridge": 9}


def _word(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def base_of(relation: Column | str) -> Column:
    """The verb of a relation: what stands before the first underscore."""
    return F.substring_index(relation, "_", 1)


def prep_of(relation: Column | str) -> Column:
    """What stands after the first underscore; null without one."""
    r = F.col(relation) if isinstance(relation, str) else relation
    return F.when(F.contains(r, F.lit("_")), F.substring(r, F.instr(r, "_") + 1, 1_000_000))


def fact_table(triples: DataFrame) -> DataFrame:
    """The edges with what the triples of the same subject, relation and object say: the last verb, surface form and case that are not
    empty, the last passive flag, and the depths of the first."""
    filled = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("ord")))
    facts = G.valid_triples(triples).groupBy("doc_id", F.col("subject").alias("src"), "relation", F.col("object").alias("dst")).agg(
        F.coalesce(filled("verb_text"), F.lit("")).alias("verb"),
        F.coalesce(F.max_by("is_passive", "ord"), F.lit(False)).alias("is_passive"),
        F.coalesce(filled("object_surface"), F.lit("")).alias("surface"),
        F.coalesce(filled("object_case"), F.lit("")).alias("case"),
        F.min_by(D.local_score(F.coalesce("source_depth", F.lit(0)), F.coalesce("answer_depth", F.lit(0)), F.coalesce("coref_distance", F.lit(0))), "ord").alias("s_local"),
    )
    return G.edges(triples).join(facts, ["doc_id", "src", "relation", "dst"])


def question_word(answer_type: Column, lang: str = "en") -> Column:
    return _word(L.TABLES[lang][0], answer_type, L.TABLES[lang][1])


def _line(*parts: Column | str) -> Column:
    """The parts with blanks between them and a question mark; names of columns begin with a dollar."""
    return F.concat(F.concat_ws(" ", *[F.col(x[1:]) if isinstance(x, str) and x[:1] == "$" else F.lit(x) if isinstance(x, str) else x for x in parts]), F.lit("?"))


def with_clitic(verb: Column) -> Column:
    """The Finnish verb as the beginning of a yes/no question: -ko or -kö by its last vowel that asks for one, in capital letter."""
    last = F.lower(F.regexp_extract(verb, "([aouäöyAOUÄÖY])[^aouäöyAOUÄÖY]*$", 1))
    asked = F.concat(verb, F.when(last.isin("ä", "ö", "y"), "kö").otherwise("ko"))
    return F.concat(F.upper(F.substring(asked, 1, 1)), F.lower(F.substring(asked, 2, 1_000_000)))


def _implied(word: Column, prep: Column) -> Column:
    return F.when(word == "When", prep.isin(*L.IMPLIED_PREPS["When"])).when(word == "Where", prep.isin(*L.IMPLIED_PREPS["Where"])).otherwise(F.lit(False))


def _shape(rows: DataFrame, kind: str, text: Column, answer: Column, answer_type: Column, order: Column, *, s_local: Column, passive: Column | None = None, hops: int = 1, answer_list: Column | None = None, s_type: float | None = None, s_vocab: Column | None = None, fixed: Column | None = None) -> DataFrame:
    passive = F.lit(False) if passive is None else passive
    return rows.select(
        "doc_id",
        F.lit(kind).alias("kind"),
        F.lit(PLACE[kind]).alias("kind_no"),
        order.alias("ord"),
        text.alias("text"),
        answer.alias("answer"),
        answer_type.alias("answer_type"),
        (F.lit(None) if answer_list is None else answer_list).cast("array<string>").alias("answer_list"),
        F.lit(hops).cast("bigint").alias("hop_count"),
        passive.alias("is_passive"),
        F.lit(float(D.TYPE_SCORES[kind] if s_type is None else s_type)).alias("s_type"),
        s_local.cast("double").alias("s_local"),
        (F.lit(0.0) if s_vocab is None else s_vocab).alias("s_vocab"),
        (F.lit(None) if fixed is None else fixed).cast("string").alias("fixed_level"),
    ).where(F.col("text").isNotNull())


def _order(side: int = 0) -> Column:
    """A sortable place: the edge's place in the document's walk, then the side asked for."""
    e = F.col("edge_ord")
    return F.format_string("%012d.%012d.%012d.%d", e["src_ord"].cast("bigint"), e["first"].cast("bigint"), e["ord"].cast("bigint"), F.lit(side))


def wh_questions(facts: DataFrame, lang: str = "en") -> DataFrame:
    """Questions for the object and for the subject of each typed edge, and for all objects of a kind at once."""
    verb = base_of("relation")
    typed = facts.where(~verb.isin(*L.SKIP_VERBS) & F.col("src_type").isNotNull() & F.col("dst_type").isNotNull() & ~F.col("relation").endswith("_as"))
    typed = typed.withColumns({"base": verb, "prep": prep_of("relation"), "plain": ~F.contains(F.col("relation"), F.lit("_"))})
    by = F.col("relation").endswith("_by")
    group = lambda *keys: Window.partitionBy("doc_id", *keys)
    listed = F.col("plain") | by
    place = F.struct("edge_ord")
    vt = F.when(F.col("verb") != "", F.col("verb")).otherwise(F.col("base"))

    objects = typed.where(~F.col("dst_type").isin(*L.OBJECT_SKIP))
    members = facts.where((~F.contains(F.col("relation"), F.lit("_")) | by) & F.col("dst_type").isNotNull()).groupBy("doc_id", "src", "relation", "dst_type", "dst").agg(F.min("edge_ord").alias("o"))
    members = members.groupBy("doc_id", "src", "relation", "dst_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "dst"))), lambda x: x["dst"]).alias("members"))
    objects = objects.join(members, ["doc_id", "src", "relation", "dst_type"], "left")
    objects = objects.withColumn("first", F.row_number().over(group("src", "relation", "dst_type").orderBy(place)) == 1)
    many = listed & (F.size(F.coalesce("members", F.array().cast("array<string>"))) >= 2) & F.col("first")
    word = F.when(F.col("case") != "", F.coalesce(_word(L.TABLES[lang][2], F.col("case")), question_word(F.col("dst_type"), lang))).otherwise(question_word(F.col("dst_type"), lang))
    objects = objects.withColumns({"many": many, "word": word, "vt": vt})
    by_word = F.when(F.col("word") == "Who", "By whom").when(F.col("word") == "What", "By what").otherwise(F.concat(F.lit("By "), F.lower("word")))
    passive = (
        F.when(by, F.concat(by_word, F.lit(" was "), "src", F.lit(" "), "vt", F.lit("?")))
        .when(F.col("prep").isNotNull() & ~_implied(F.col("word"), F.col("prep")), F.concat("word", F.lit(" was "), "src", F.lit(" "), "vt", F.lit(" "), "prep", F.lit("?")))
        .otherwise(F.concat("word", F.lit(" was "), "src", F.lit(" "), "vt", F.lit("?")))
    )
    active = F.concat("word", F.lit(" did "), "src", F.lit(" "), "base", F.lit("?"))
    text = F.when(F.col("is_passive"), passive).otherwise(active) if lang == "en" else _line("$word", "$src", "$vt")
    nouns = _word(L.TABLES[lang][4], F.col("dst_type"))
    together = objects.where(F.col("many") & F.col("plain") & nouns.isNotNull())
    aggregation = _shape(
        together, "aggregation", _line("What", nouns, "did", "$src", "$base") if lang == "en" else _line("Mitä", nouns, "$src", "$base"), F.array_join("members", ", "), F.col("dst_type"), _order(0), s_local=F.col("s_local"), answer_list=F.col("members")
    )
    alone = objects.where(~(F.col("many") & F.col("plain") & nouns.isNotNull()))
    lists = F.when(F.col("many"), F.col("members"))
    asked = _shape(alone, "object", text, F.col("dst"), F.col("dst_type"), _order(0), s_local=F.col("s_local"), passive=F.col("is_passive"), answer_list=lists)

    place_pair = F.col("src_type").isin(*L.PLACES) & F.col("dst_type").isin(*L.PLACES)
    subjects = typed.where(~F.col("dst_type").isin(*L.SUBJECT_SKIP) & ~place_pair & (F.col("plain") | by))
    doers = facts.where(~F.contains(F.col("relation"), F.lit("_")) & F.col("src_type").isNotNull()).groupBy("doc_id", "dst", "relation", "src_type", "src").agg(F.min("edge_ord").alias("o"))
    doers = doers.groupBy("doc_id", "dst", "relation", "src_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "src"))), lambda x: x["src"]).alias("members"))
    subjects = subjects.join(doers, ["doc_id", "dst", "relation", "src_type"], "left")
    subjects = subjects.withColumn("first", F.row_number().over(group("dst", "relation", "src_type").orderBy(place)) == 1)
    shared = F.col("plain") & (F.size(F.coalesce("members", F.array().cast("array<string>"))) >= 2)
    subjects = subjects.where(~shared | F.col("first")).withColumns({"word": question_word(F.col("src_type"), lang), "vt": vt, "shared": shared})
    s_text = F.when(
        F.col("is_passive"), F.when(F.col("prep").isNotNull(), F.concat("word", F.lit(" was "), "vt", F.lit(" "), "prep", F.lit(" "), "dst", F.lit("?"))).otherwise(F.concat("word", F.lit(" was "), "vt", F.lit("?")))
    ).otherwise(F.concat("word", F.lit(" "), "vt", F.lit(" "), "dst", F.lit("?")))
    if lang == "fi":
        s_text = _line("$word", "$vt", F.when(F.col("surface") != "", F.col("surface")).otherwise(F.col("dst")))
    by_subject = _shape(subjects, "subject", s_text, F.col("src"), F.col("src_type"), _order(1), s_local=F.col("s_local"), passive=F.col("is_passive"), answer_list=F.when(F.col("shared"), F.col("members")))
    return asked.unionByName(by_subject).unionByName(aggregation)


def _claims(facts: DataFrame) -> DataFrame:
    """The edges that a yes/no question can be about."""
    rows = facts.withColumns({"base": F.replace(base_of("relation"), F.lit("co-"), F.lit("")), "prep": prep_of("relation")})
    rows = rows.where(~F.col("relation").endswith("_by") & ~F.col("base").isin(*L.SKIP_VERBS))
    passive_ok = F.col("is_passive") & ~F.coalesce(F.col("prep").isin(*L.YESNO_PASSIVE_SKIP), F.lit(False))
    active_ok = ~F.col("is_passive") & F.col("prep").isNull() & ~F.coalesce(F.col("dst_type").isin(*L.YESNO_SKIP), F.lit(False))
    return rows.where(passive_ok | active_ok)


def _yesno(obj: Column, lang: str = "en") -> Column:
    vt = F.when(F.col("verb") != "", F.col("verb")).otherwise(F.col("base"))
    if lang == "fi":
        return F.when(F.col("is_passive"), _line(with_clitic(vt), "$src")).otherwise(_line(with_clitic(vt), "$src", obj))
    passive = F.when(F.col("prep").isNotNull(), F.concat(F.lit("Was "), "src", F.lit(" "), vt, F.lit(" "), "prep", F.lit(" "), obj, F.lit("?"))).otherwise(F.concat(F.lit("Was "), "src", F.lit(" "), vt, F.lit("?")))
    return F.when(F.col("is_passive"), passive).otherwise(F.concat(F.lit("Did "), "src", F.lit(" "), "base", F.lit(" "), obj, F.lit("?")))


def true_claims(facts: DataFrame, lang: str = "en") -> DataFrame:
    return _shape(_claims(facts), "true_claim", _yesno(F.col("dst"), lang), F.lit("Yes"), F.lit(None).cast("string"), _order(0), s_local=F.col("s_local"), passive=F.col("is_passive"))


def false_claims(facts: DataFrame, triples: DataFrame, lang: str = "en", least_degree: int = 3) -> DataFrame:
    """The object replaced by another name of its type: one with several edges, of which no such fact is known and which the sentence
    does not mention; the one with most edges (ties: the earliest)."""
    claims = _claims(facts).where((F.col("source") != "") & F.col("dst_type").isin(*L.DISTRACTOR_TYPES))
    names = G.nodes(triples).join(G.degrees(triples).where(F.col("degree") >= least_degree), ["doc_id", "node"])
    names = names.select("doc_id", F.col("node").alias("other"), F.col("entity_type").alias("dst_type"), "degree", "node_ord")
    names = names.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "dst_type").orderBy(F.desc("degree"), "node_ord")))
    known = facts.select("doc_id", "src", "relation", F.col("dst").alias("other")).distinct()

    def best(asked: DataFrame, among: DataFrame) -> DataFrame:
        pairs = asked.join(among, ["doc_id", "dst_type"]).where((F.col("other") != F.col("dst")) & (F.col("other") != F.col("src")))
        mentioned = F.exists(F.filter(F.split("other", r"\s+"), lambda w: w != ""), lambda w: F.contains(F.col("source"), w))
        pairs = pairs.where(~mentioned).join(known, ["doc_id", "src", "relation", "other"], "left_anti")
        return pairs.withColumn("best", F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("place"))).where("best = 1").select(*claims.columns, "other")

    # The first names of a type serve nearly every claim; only claims that all of them fail meet the others, so the claims and
    # names of a large document do not all meet.
    first = materialise(best(claims, names.where(F.col("place") <= FIRST_NAMES)), "claims")
    many = names.where(F.col("place") > FIRST_NAMES)
    chosen = first.unionByName(best(claims.join(first.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti"), many))
    return _shape(chosen, "false_claim", _yesno(F.col("other"), lang), F.lit("No"), F.lit(None).cast("string"), _order(1), s_local=F.col("s_local"), passive=F.col("is_passive"))


def _bare(facts: DataFrame) -> DataFrame:
    """Edges whose relation is a verb alone."""
    rows = facts.withColumn("base", F.replace(base_of("relation"), F.lit("co-"), F.lit("")))
    return rows.where(~F.contains(F.col("relation"), F.lit("_")) & ~F.col("base").isin(*L.SKIP_VERBS))


def _hinted(facts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Edges with a preposition to one of the types, keyed by sentence, subject and verb."""
    rows = facts.where((F.col("source") != "") & F.contains(F.col("relation"), F.lit("_")) & F.col("dst_type").isin(*types))
    return rows.select("doc_id", "source", "src", F.replace(base_of("relation"), F.lit("co-"), F.lit("")).alias("base"), prep_of("relation").alias("hint_prep"), F.col("dst").alias("hint"), F.col("dst_type").alias("hint_type"), F.col("edge_ord").alias("hint_ord"))


def which_questions(facts: DataFrame, lang: str = "en") -> DataFrame:
    """Two objects or more of one type, each told apart by when or where: the last time given in its sentence, else the first place."""
    objects = _bare(facts).where((F.col("source") != "") & F.col("dst_type").isin(*L.WHICH_TYPES))
    time = F.col("hint_type").isin(*L.TIMES)
    hints = _hinted(facts, ("DATE", "TIME", "GPE", "LOC")).groupBy("doc_id", "source", "src", "base").agg(
        F.coalesce(F.max_by(F.struct("hint_prep", "hint"), F.when(time, F.col("hint_ord"))), F.min_by(F.struct("hint_prep", "hint"), F.when(~time, F.col("hint_ord")))).alias("h")
    )
    rows = objects.join(hints, ["doc_id", "source", "src", "base"])
    w = Window.partitionBy("doc_id", "src", "base")
    rows = rows.withColumns({"n": F.count("*").over(w), "lo": F.min("dst_type").over(w), "hi": F.max("dst_type").over(w)}).where("n >= 2 AND lo = hi")
    noun = _word(L.TABLES[lang][5], F.col("dst_type"))
    text = _line("Which", noun, "did", "$src", "$base", "$h.hint_prep", "$h.hint") if lang == "en" else _line("Minkä", noun, "$src", "$base", "$h.hint")
    return _shape(rows, "which", text, F.col("dst"), F.col("dst_type"), _order(0), s_local=F.lit(0.1))


def count_questions(facts: DataFrame, lang: str = "en") -> DataFrame:
    rows = _bare(facts).groupBy("doc_id", "src", "relation", "base", "dst_type", "dst").agg(F.min("edge_ord").alias("edge_ord"), F.min_by("s_local", "edge_ord").alias("s_local"))
    rows = rows.groupBy("doc_id", "src", "relation", "base", "dst_type").agg(F.count("*").alias("n"), F.min("edge_ord").alias("edge_ord"), F.min_by("s_local", "edge_ord").alias("s_local")).where("n >= 2")
    noun = _word(L.TABLES[lang][4], F.col("dst_type"))
    line = _line("How many", noun, "did", "$src", "$base") if lang == "en" else _line("Montako", noun, "$src", "$base")
    text = F.when(noun.isNotNull(), line)
    return _shape(rows, "count", text, F.col("n").cast("string"), F.lit("CARDINAL"), _order(0), s_local=F.col("s_local"))


def comparison_questions(facts: DataFrame, lang: str = "en") -> DataFrame:
    """Pairs of one subject's objects with different years: which was earlier, which later; an unordered pair once in a document."""
    objects = _bare(facts).where((F.col("source") != "") & F.col("dst_type").isin(*L.COMPARED_TYPES))
    years = _hinted(facts, L.TIMES).withColumn("year", T.first_year("hint")).where("year IS NOT NULL").groupBy("doc_id", "source", "src", "base").agg(F.min_by("year", "hint_ord").alias("year"))
    dated = objects.join(years, ["doc_id", "source", "src", "base"]).select("doc_id", "src", "base", "dst", "dst_type", "year", "edge_ord", F.when(F.col("verb") != "", F.col("verb")).otherwise(F.col("base")).alias("vt"))
    a = dated.select("doc_id", "src", "base", "vt", "edge_ord", F.col("dst").alias("a"), F.col("dst_type").alias("type"), F.col("year").alias("ya"))
    b = dated.select("doc_id", "src", "base", F.col("edge_ord").alias("edge_b"), F.col("dst").alias("b"), F.col("dst_type").alias("type"), F.col("year").alias("yb"))
    pairs = a.join(b, ["doc_id", "src", "base", "type"]).where("edge_ord < edge_b AND a <> b AND ya <> yb")
    first = F.row_number().over(Window.partitionBy("doc_id", F.least("a", "b"), F.greatest("a", "b")).orderBy("edge_ord", "edge_b"))
    pairs = pairs.withColumn("k", first).where("k = 1").withColumn("early", F.explode(F.array(F.lit(True), F.lit(False))))
    text = F.concat(F.lit("Which was "), "vt", F.lit(" "), F.when(F.col("early"), "earlier").otherwise("later"), F.lit(", "), "a", F.lit(" or "), "b", F.lit("?"))
    if lang == "fi":
        text = F.concat(F.lit("Kumpi tapahtui "), F.when(F.col("early"), "aikaisemmin").otherwise("myöhemmin"), F.lit(", "), _line("$a", "vai", "$b"))
    answer = F.when(F.col("early") == (F.col("ya") < F.col("yb")), F.col("a")).otherwise(F.col("b"))
    order = F.concat(_order(0), F.when(F.col("early"), "0").otherwise("1"))
    return _shape(pairs, "comparison", text, answer, F.col("type"), order, s_local=F.lit(0.25))


def chain_questions(facts: DataFrame, lang: str = "en") -> DataFrame:
    """Two edges in a row over a person, asked through the role the first one gives the person; as local as the second edge."""
    one = facts.select("doc_id", F.col("src").alias("start"), F.col("dst").alias("src"), F.col("relation").alias("r1"), F.col("dst_type").alias("bridge_type"), F.col("edge_ord").alias("o1"))
    one = one.withColumn("noun", _word(L.TABLES[lang][3], base_of("r1"))).where(F.col("noun").isNotNull() & F.col("bridge_type").isin(*G.PERSON) & (F.col("start") != F.col("src")))
    rows = one.join(facts, ["doc_id", "src"]).where((F.col("dst") != F.col("src")) & (F.col("dst") != F.col("start")) & F.col("dst_type").isNotNull())
    word = question_word(F.col("dst_type"), lang)
    vt = F.when(F.col("verb") != "", F.col("verb")).otherwise(base_of("relation"))
    role = F.concat(F.lit("the "), "noun", F.lit(" of "), "src")
    text = F.when(F.col("is_passive"), F.concat(word, F.lit(" was "), role, F.lit(" "), vt, F.lit("?"))).otherwise(F.concat(word, F.lit(" did "), role, F.lit(" "), base_of("relation"), F.lit("?")))
    if lang == "fi":
        text = _line(word, F.concat("src", F.lit("n")), "$noun", vt)
    return _shape(rows, "chain", text, F.col("dst"), F.col("dst_type"), _order(0), s_local=F.coalesce("s_local", F.lit(0.15)), passive=F.col("is_passive"), hops=2)


def _events(rows: DataFrame, *keys: str) -> DataFrame:
    """The different sentences of a key, in order; keys with one or two of them."""
    got = rows.groupBy("doc_id", *keys, "source").agg(F.min("edge_ord").alias("o")).groupBy("doc_id", *keys).agg(F.array_sort(F.collect_list(F.struct("o", "source"))).alias("e"))
    got = got.where(F.size("e").between(1, 2))
    return got.withColumns({"edge_ord": F.col("e")[0]["o"], "events": F.transform("e", lambda x: x["source"]), "n": F.size("e")})


def subgraph_questions(facts: DataFrame, lang: str = "en") -> DataFrame:
    """What a name did or what happened at it, where one or two sentences tell; and the same for a subject and a time or place together."""
    told = facts.where((F.col("source") != "") & ~base_of("relation").isin(*L.SKIP_VERBS) & ~F.col("relation").endswith("_as"))
    ends = F.array(F.struct(F.col("src").alias("anchor"), F.col("src_type").alias("type"), F.col("src_type").isin(*L.SUBJECT_ANCHORS).alias("ok")), F.struct(F.col("dst").alias("anchor"), F.col("dst_type").alias("type"), F.col("dst_type").isin(*L.OBJECT_ANCHORS).alias("ok")))
    single = told.select("doc_id", "source", "edge_ord", F.explode(ends).alias("x")).where("x.ok").select("doc_id", "source", "edge_ord", "x.anchor", "x.type")
    events = _events(single, "anchor", "type")
    text = F.when(F.col("type").isin(*L.SUBJECT_ANCHORS), F.concat(F.lit("What did "), "anchor", F.lit(" do?"))).otherwise(F.concat(F.lit("What happened in "), "anchor", F.lit("?")))
    if lang == "fi":
        text = F.when(F.col("type").isin(*L.SUBJECT_ANCHORS), _line("Mitä", "$anchor", "teki")).otherwise(_line("Mitä", "tapahtui", "$anchor"))
    level = F.when(F.col("n") == 1, "A1").otherwise("A2")
    local = F.when(F.col("n") == 1, 0.0).otherwise(0.5)
    one = _shape(events, "subgraph", text, F.col("events")[0], F.col("type"), _order(0), s_local=local, answer_list=F.col("events"), fixed=level)
    pairs = told.where(F.col("src_type").isin(*L.SUBJECT_ANCHORS) & F.col("dst_type").isin(*L.OBJECT_ANCHORS))
    events = _events(pairs, "src", "dst", "dst_type")
    text = F.concat(F.lit("What did "), "src", F.lit(" do "), _word(L.OBJECT_PREPS, F.col("dst_type"), "in"), F.lit(" "), "dst", F.lit("?"))
    if lang == "fi":
        text = _line("Mitä", "$src", "teki", "$dst")
    two = _shape(events, "pair_subgraph", text, F.col("events")[0], F.col("dst_type"), _order(0), s_local=local, answer_list=F.col("events"), fixed=level, s_type=D.TYPE_SCORES["subgraph"])
    return one.unionByName(two)


def chain_subgraph_questions(facts: DataFrame) -> DataFrame:
    """What the holder of a role did at a time or place, where one or two sentences that name the role's owner tell."""
    noun = _word(L.RELATION_NOUNS, base_of("relation"))
    roles = facts.where(noun.isNotNull()).withColumn("noun", noun)
    by = F.col("relation").endswith("_by")
    turned = by & F.col("src_type").isin(*L.SUBJECT_ANCHORS) & F.col("dst_type").isin(*L.SUBJECT_ANCHORS)
    straight = ~by & F.col("src_type").isin(*L.SUBJECT_ANCHORS) & F.col("dst_type").isin(*L.SUBJECT_ANCHORS)
    roles = roles.where(turned | straight).select("doc_id", F.when(by, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(by, F.col("src")).otherwise(F.col("dst")).alias("anchor"), "noun").distinct()
    told = facts.where((F.col("source") != "") & ~base_of("relation").isin(*L.SKIP_VERBS) & F.col("dst_type").isin(*L.OBJECT_ANCHORS))
    rows = roles.join(told, ["doc_id", "src"]).where(F.contains(F.col("source"), F.col("anchor")))
    events = _events(rows, "anchor", "noun", "dst", "dst_type")
    text = F.concat(F.lit("What did the "), "noun", F.lit(" of "), "anchor", F.lit(" do "), _word(L.OBJECT_PREPS, F.col("dst_type"), "in"), F.lit(" "), "dst", F.lit("?"))
    local = F.when(F.col("n") == 1, 0.0).otherwise(0.5)
    return _shape(events, "chain_subgraph", text, F.col("events")[0], F.col("dst_type"), _order(0), s_local=local, hops=2, answer_list=F.col("events"), s_vocab=F.lit(0.5))


def bridge_questions(facts: DataFrame, triples: DataFrame) -> DataFrame:
    """A name asked for by an edge into it and one out of it, told in different sentences; of the edges out, the one to the name with most edges."""
    usable = ~F.col("relation").endswith("_by") & ~F.col("relation").endswith("_as") & ~base_of("relation").isin(*L.SKIP_VERBS) & (F.col("source") != "")
    into = facts.where(usable & F.col("src_type").isin(*L.BRIDGE_ANCHORS) & F.col("dst_type").isin(*L.BRIDGE_TYPES)).select(
        "doc_id", F.col("src").alias("anchor"), F.col("dst").alias("src"), F.col("dst_type").alias("bridge_type"), base_of("relation").alias("verb1"), F.col("source").alias("source1"), F.col("edge_ord").alias("in_ord")
    )
    out = facts.where(usable & ~F.coalesce(F.col("dst_type").isin(*L.BRIDGE_END_SKIP), F.lit(False))).join(G.degrees(triples).select("doc_id", F.col("node").alias("dst"), "degree"), ["doc_id", "dst"])
    rows = into.join(out, ["doc_id", "src"]).where((F.col("dst") != F.col("anchor")) & (F.col("dst") != F.col("src")) & (F.col("source") != F.col("source1")))
    best = F.row_number().over(Window.partitionBy("doc_id", "src", "in_ord").orderBy(F.desc("degree"), "edge_ord"))
    rows = rows.withColumn("best", best).where("best = 1")
    vt = F.when(F.col("verb") != "", F.col("verb")).otherwise(base_of("relation"))
    phrase = F.concat_ws(" ", vt, prep_of("relation"))
    text = F.concat(F.lit("Which "), _word(L.SINGULARS, F.col("bridge_type")), F.lit(" did "), "anchor", F.lit(" "), "verb1", F.lit(" that "), phrase, F.lit(" "), "dst", F.lit("?"))
    return _shape(rows.withColumn("edge_ord", F.col("in_ord")), "bridge", text, F.col("src"), F.col("bridge_type"), _order(0), s_local=F.lit(0.5), hops=2, fixed=F.lit("C1"))


def all_questions(triples: DataFrame, lang: str = "en") -> DataFrame:
    """Every kind of question of every document, in English (en) or Finnish (fi; without chains of events and bridges). The facts are
    written once, as every kind reads them. Another language has no templates and gives no questions."""
    if lang not in L.TABLES:
        return all_questions(triples.limit(0))
    facts = materialise(fact_table(triples), "facts")
    kinds = [f(facts, lang) for f in (wh_questions, true_claims, which_questions, count_questions, comparison_questions, chain_questions, subgraph_questions)]
    kinds.append(false_claims(facts, triples, lang))
    if lang == "en":
        kinds += [chain_subgraph_questions(facts), bridge_questions(facts, triples)]
    return reduce(DataFrame.unionByName, kinds)


def assemble(questions: DataFrame, passages: DataFrame, limit: int = 10, lowest: str = "preA1", highest: str = "C2+") -> DataFrame:
    """(doc_id, rank, kind, text, answer, level): each text once in a document, first come first, within the levels wanted; the hardest
    first. passages: (doc_id, text), for the readability."""
    rest = [c for c in QUESTION if c not in ("doc_id", "text")]
    once = questions.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.struct("kind_no", "ord")).alias("q")).select("doc_id", "text", "q.*")
    reads = passages.select("doc_id", F.coalesce(T.lix("text").cast("double"), F.lit(0.0)).alias("s_read"))
    scored = once.join(reads, "doc_id", "left").withColumn("s_read", F.coalesce("s_read", F.lit(0.0)))
    level = F.coalesce("fixed_level", D.level(F.col("s_type"), F.col("s_local"), F.col("s_vocab"), F.col("s_read")))
    scored = scored.withColumn("level", level).withColumn("level_no", T.level_ordinal("level"))
    low, high = T.LEVELS.index(lowest), T.LEVELS.index(highest)
    inside = scored.where(F.col("level_no").between(low, high))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("level_no"), "kind_no", "ord", "text"))
    return inside.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit).select("doc_id", "rank", "kind", "text", "answer", "level")
