"""Queries over the triples: graphs, mentions, paths, and questions by templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readq.operators import graph as G
from readq.operators import questions as Q
from readq.session import materialise, table


def _triples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "triples")


def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return G.nodes(_triples(s, d))


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return G.edges(_triples(s, d)).select("doc_id", "ord", "src", "dst", "relation", "src_type", "dst_type")


def graph_degrees(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(_triples(s, d))


def graph_neighbours(s: SparkSession, d: str) -> DataFrame:
    return G.neighbours(_triples(s, d))


def graph_summary(s: SparkSession, d: str) -> DataFrame:
    return G.summary(_triples(s, d))


def graph_paths(s: SparkSession, d: str) -> DataFrame:
    return G.paths(G.edges(_triples(s, d)), 3).select("doc_id", F.array_join("path", " > ").alias("path"), F.array_join("relations", " > ").alias("relations"), "n_hops")


def sibling_groups(s: SparkSession, d: str) -> DataFrame:
    return G.siblings(G.edges(_triples(s, d))).select("doc_id", "src", "relation", "type", "n", F.array_join(F.array_sort("members"), "|").alias("members"))


def mentions_resolved(s: SparkSession, d: str) -> DataFrame:
    return G.resolve_mentions(_triples(s, d)).select("doc_id", "ord", "subject", "object", F.col("coref_distance").cast("bigint").alias("coref_distance"))


def _kind(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        facts = Q.fact_table(_triples(s, d))
        build = {"wh": Q.wh_questions, "true": Q.true_claims, "which": Q.which_questions, "count": Q.count_questions, "comparison": Q.comparison_questions, "chain": Q.chain_questions, "subgraph": Q.subgraph_questions, "chain_subgraph": Q.chain_subgraph_questions}
        with_triples = {"false": Q.false_claims, "bridge": Q.bridge_questions}
        rows = build[name](facts) if name in build else with_triples[name](facts, _triples(s, d))
        scores = [F.round(c, 9).alias(c) for c in ("s_type", "s_local", "s_vocab")]
        return rows.select("doc_id", "kind", "text", "answer", "answer_type", "hop_count", "is_passive", F.array_join("answer_list", "|").alias("answers"), "fixed_level", *scores)

    query.__name__ = f"q_{name}"
    return query


def question_levels(s: SparkSession, d: str) -> DataFrame:
    """The ten hardest questions of each document."""
    questions = materialise(Q.all_questions(_triples(s, d)), "questions")
    return Q.assemble(questions, table(s, d, "documents"))


_valid = "v AS (SELECT * FROM triples WHERE doc_id IS NOT NULL AND ord IS NOT NULL AND trim(subject) <> '' AND trim(relation) <> '' AND trim(object) <> '')"
_ends = "m AS (SELECT doc_id, subject AS node, subject_type AS t, ord::BIGINT * 2 AS pos FROM v UNION ALL SELECT doc_id, object, object_type, ord::BIGINT * 2 + 1 FROM v)"
_nodes = "n AS (SELECT doc_id, node, t AS entity_type, pos AS node_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node ORDER BY pos) AS k FROM m) WHERE k = 1)"
_edges = "e AS (SELECT v.doc_id, ord, subject AS src, object AS dst, relation, source, a.entity_type AS src_type, b.entity_type AS dst_type, a.node_ord AS src_ord, min(ord) OVER (PARTITION BY v.doc_id, subject, object) AS first_ord FROM v JOIN n a ON a.doc_id = v.doc_id AND a.node = subject JOIN n b ON b.doc_id = v.doc_id AND b.node = object)"
_graph = f"{_valid}, {_ends}, {_nodes}, {_edges}"
_facts = """k AS (SELECT doc_id, subject AS src, relation, object AS dst, coalesce(arg_max(verb_text, ord) FILTER (verb_text <> ''), '') AS verb, coalesce(arg_max(is_passive, ord), false) AS is_passive, coalesce(arg_max(object_case, ord) FILTER (object_case <> ''), '') AS ocase, arg_min((least(coalesce(source_depth, 0), 3) / 3 + least(greatest(coalesce(answer_depth, 0) - 1, 0), 2) / 2 + least(coalesce(coref_distance, 0), 3) / 3) / 3, ord) AS s_local FROM v GROUP BY 1, 2, 3, 4),
f AS (SELECT e.*, k.verb, k.is_passive, k.s_local, k.ocase, string_split(relation, '_')[1] AS base, CASE WHEN contains(relation, '_') THEN substr(relation, instr(relation, '_') + 1) END AS prep FROM e JOIN k USING (doc_id, src, relation, dst))"""


def _case(table_: dict[str, str], key: str, default: str = "NULL") -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {default} END"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


L = Q.L
_mention = f"""
m1 AS (SELECT doc_id, ord, sentence_idx, 2 * ord AS k, subject AS name, subject_type AS type FROM v UNION ALL SELECT doc_id, ord, sentence_idx, 2 * ord + 1, object, object_type FROM v),
m2 AS (SELECT *, lower(name) IN {_in(G.PRONOUNS["en"])} AS pronoun, len(regexp_split_to_array(trim(name), '\\s+')) AS n, lower(regexp_split_to_array(trim(name), '\\s+')[-1]) AS last FROM m1),
i AS (SELECT doc_id, name, type, last, min(k) AS k, arg_min(ord, k) AS ord, arg_min(sentence_idx, k) AS s FROM m2 WHERE n > 1 AND type IS NOT NULL AND NOT pronoun GROUP BY 1, 2, 3, 4),
r AS (SELECT a.doc_id, a.k, a.name, a.type, a.ord, a.sentence_idx, (SELECT arg_max(struct_pack(name := i.name, s := i.s), length(i.name) * 1000000 - i.k) FROM i WHERE i.doc_id = a.doc_id AND i.type = a.type AND i.last = a.last AND i.ord < a.ord) AS best FROM m2 a WHERE n = 1 AND type IS NOT NULL AND NOT pronoun),
p AS (SELECT doc_id, name, type, k, ord, s FROM i WHERE type IN ('PERSON', 'PER') UNION ALL SELECT doc_id, name, type, min(k), arg_min(ord, k), arg_min(sentence_idx, k) FROM r WHERE best IS NULL AND type IN ('PERSON', 'PER') GROUP BY 1, 2, 3),
w AS (SELECT a.doc_id, a.k, a.sentence_idx, (SELECT arg_max(struct_pack(name := p.name, s := p.s), p.k) FROM p WHERE p.doc_id = a.doc_id AND p.ord < a.ord) AS best FROM m2 a WHERE pronoun),
x AS (SELECT doc_id, k, best.name AS name, sentence_idx - best.s AS d FROM r WHERE best IS NOT NULL UNION ALL SELECT doc_id, k, best.name, sentence_idx - best.s FROM w WHERE best IS NOT NULL)"""
_vt = "CASE WHEN verb <> '' THEN verb ELSE base END"
_claims = f"""c AS (SELECT *, replace(base, 'co-', '') AS b0 FROM f WHERE NOT ends_with(relation, '_by')), c2 AS (SELECT * EXCLUDE (base), b0 AS base FROM c WHERE b0 NOT IN {_in(L.SKIP_VERBS)}
  AND ((is_passive AND coalesce(prep, '') NOT IN {_in(L.YESNO_PASSIVE_SKIP)}) OR (NOT is_passive AND prep IS NULL AND coalesce(dst_type, '') NOT IN {_in(L.YESNO_SKIP)})))"""
_yesno = "CASE WHEN is_passive THEN 'Was ' || src || ' ' || " + _vt + " || CASE WHEN prep IS NOT NULL THEN ' ' || prep || ' ' || {0} ELSE '' END || '?' ELSE 'Did ' || src || ' ' || base || ' ' || {0} || '?' END"
_told = f"source <> '' AND base NOT IN {_in(L.SKIP_VERBS)}"
_place = "struct_pack(a := src_ord, b := first_ord, c := ord)"
_qw = _case(L.QUESTION_WORDS, "{0}", "'What'")
def _scored(s_type: float, s_local: str = "s_local", *, hops: int = 1, passive: str = "false", answers: str = "NULL::VARCHAR", level: str = "NULL::VARCHAR", s_vocab: float = 0.0) -> str:
    """What a question says beside its text and answer."""
    return f"{hops} AS hop_count, {passive} AS is_passive, {answers} AS answers, {level} AS fixed_level, {s_type}::DOUBLE AS s_type, round(({s_local})::DOUBLE, 9) AS s_local, {s_vocab}::DOUBLE AS s_vocab"


_yes = _scored(0.2, passive="is_passive")
_few = "CASE WHEN n = 1 THEN 0.0 ELSE 0.5 END"
_listed = "array_to_string(events, '|')"
_by_n = "CASE WHEN n = 1 THEN 'A1' ELSE 'A2' END"


def _event_list(rows: str, keys: str) -> str:
    """The different sentences of a key in order, where there are one or two."""
    return f"(SELECT doc_id, {keys}, list(source ORDER BY o) AS events, count(*) AS n FROM (SELECT doc_id, {keys}, source, min(o) AS o FROM {rows} GROUP BY ALL) GROUP BY doc_id, {keys} HAVING count(*) <= 2)"


_deg = "g AS (SELECT doc_id, node AS dst, count(*) AS degree FROM (SELECT doc_id, subject AS node FROM v UNION ALL SELECT doc_id, object FROM v) GROUP BY 1, 2)"

SQL = {
    "graph_nodes": f"WITH {_valid}, {_ends}, {_nodes} SELECT * FROM n",
    "graph_edges": f"WITH {_graph} SELECT doc_id, ord, src, dst, relation, src_type, dst_type FROM e",
    "graph_degrees": f"WITH {_valid} SELECT doc_id, node, count(*) AS degree FROM (SELECT doc_id, subject AS node FROM v UNION ALL SELECT doc_id, object FROM v) GROUP BY 1, 2",
    "graph_neighbours": f"WITH {_valid} SELECT DISTINCT doc_id, subject AS node, object AS neighbour FROM v",
    "graph_summary": f"WITH {_valid}, {_ends} SELECT doc_id, n_nodes, n_edges FROM (SELECT doc_id, count(DISTINCT node) AS n_nodes FROM m GROUP BY 1) JOIN (SELECT doc_id, count(*) AS n_edges FROM v GROUP BY 1) USING (doc_id)",
    "graph_paths": f"""WITH RECURSIVE {_valid}, p(doc_id, path, relations, last) AS (SELECT doc_id, [subject, object], [relation], object FROM v WHERE subject <> object
        UNION ALL SELECT p.doc_id, list_append(path, v.object), list_append(relations, v.relation), v.object FROM p JOIN v ON v.doc_id = p.doc_id AND v.subject = p.last WHERE NOT list_contains(path, v.object) AND len(relations) < 3)
        SELECT doc_id, array_to_string(path, ' > ') AS path, array_to_string(relations, ' > ') AS relations, len(relations) AS n_hops FROM p""",
    "sibling_groups": f"WITH {_graph} SELECT doc_id, src, relation, dst_type AS type, count(DISTINCT dst) AS n, array_to_string(list_sort(list(DISTINCT dst)), '|') AS members FROM e WHERE dst_type IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT dst) >= 2",
    "mentions_resolved": f"WITH {_valid}, {_mention} SELECT v.doc_id, v.ord, coalesce(s.name, subject) AS subject, coalesce(o.name, object) AS object, greatest(coalesce(s.d, 0), coalesce(o.d, 0)) AS coref_distance FROM v LEFT JOIN x s ON s.doc_id = v.doc_id AND s.k = 2 * v.ord LEFT JOIN x o ON o.doc_id = v.doc_id AND o.k = 2 * v.ord + 1",
    "q_true": f"WITH {_graph}, {_facts}, {_claims} SELECT doc_id, 'true_claim' AS kind, {_yesno.format('dst')} AS text, 'Yes' AS answer, NULL::VARCHAR AS answer_type, {_yes} FROM c2",
    "q_false": f"""WITH {_graph}, {_facts}, {_claims}, {_deg}, o AS (SELECT n.doc_id, n.node AS other, n.entity_type AS other_type, n.node_ord, g.degree FROM n JOIN g ON g.doc_id = n.doc_id AND g.dst = n.node WHERE degree >= 3),
        j AS (SELECT c2.*, other, row_number() OVER (PARTITION BY c2.doc_id, c2.ord ORDER BY degree DESC, node_ord) AS k FROM c2 JOIN o ON o.doc_id = c2.doc_id AND other_type = dst_type AND other <> dst AND other <> src
          WHERE source <> '' AND dst_type IN {_in(L.DISTRACTOR_TYPES)} AND len(list_filter(regexp_split_to_array(other, '\\s+'), lambda w: w <> '' AND contains(source, w))) = 0 AND NOT EXISTS (SELECT 1 FROM f z WHERE z.doc_id = c2.doc_id AND z.src = c2.src AND z.relation = c2.relation AND z.dst = other))
        SELECT doc_id, 'false_claim' AS kind, {_yesno.format('other')} AS text, 'No' AS answer, NULL::VARCHAR AS answer_type, {_yes} FROM j WHERE k = 1""",
    "q_count": f"""WITH {_graph}, {_facts}, c AS (SELECT doc_id, src, relation, replace(base, 'co-', '') AS b, dst_type, count(DISTINCT dst) AS n, arg_min(s_local, {_place}) AS s_local FROM f WHERE NOT contains(relation, '_') GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT dst) >= 2)
        SELECT doc_id, 'count' AS kind, 'How many ' || {_case(L.PLURALS, 'dst_type')} || ' did ' || src || ' ' || b || '?' AS text, n::VARCHAR AS answer, 'CARDINAL' AS answer_type, {_scored(0.25)} FROM c WHERE b NOT IN {_in(L.SKIP_VERBS)} AND dst_type IN {_in(tuple(L.PLURALS))}""",
    "q_which": f"""WITH {_graph}, {_facts}, b AS (SELECT *, replace(base, 'co-', '') AS vb FROM f), o AS (SELECT * FROM b WHERE source <> '' AND NOT contains(relation, '_') AND vb NOT IN {_in(L.SKIP_VERBS)} AND dst_type IN {_in(L.WHICH_TYPES)}),
        h AS (SELECT doc_id, source, src, vb, coalesce(arg_max(struct_pack(p := prep, d := dst), {_place}) FILTER (dst_type IN ('DATE', 'TIME')), arg_min(struct_pack(p := prep, d := dst), {_place}) FILTER (dst_type IN ('GPE', 'LOC'))) AS h FROM b WHERE source <> '' AND contains(relation, '_') AND dst_type IN ('DATE', 'TIME', 'GPE', 'LOC') GROUP BY 1, 2, 3, 4),
        j AS (SELECT o.*, h.h, count(*) OVER w AS n, min(dst_type) OVER w AS lo, max(dst_type) OVER w AS hi FROM o JOIN h USING (doc_id, source, src, vb) WINDOW w AS (PARTITION BY o.doc_id, o.src, o.vb))
        SELECT doc_id, 'which' AS kind, 'Which ' || {_case(L.SINGULARS, 'dst_type')} || ' did ' || src || ' ' || vb || ' ' || h.p || ' ' || h.d || '?' AS text, dst AS answer, dst_type AS answer_type, {_scored(0.25, '0.1')} FROM j WHERE n >= 2 AND lo = hi""",
    "q_chain": f"""WITH {_graph}, {_facts}, a AS (SELECT doc_id, src AS start, dst AS bridge, {_case(L.RELATION_NOUNS, 'base')} AS noun FROM f WHERE dst_type IN ('PERSON', 'PER') AND src <> dst)
        SELECT f.doc_id, 'chain' AS kind, {_qw.format('dst_type')} || CASE WHEN is_passive THEN ' was the ' || noun || ' of ' || src || ' ' || {_vt} ELSE ' did the ' || noun || ' of ' || src || ' ' || base END || '?' AS text, dst AS answer, dst_type AS answer_type, {_scored(0.35, hops=2, passive='is_passive')}
        FROM a JOIN f ON f.doc_id = a.doc_id AND f.src = a.bridge WHERE noun IS NOT NULL AND dst <> src AND dst <> start AND dst_type IS NOT NULL""",
    "q_subgraph": f"""WITH {_graph}, {_facts}, t AS (SELECT * FROM f WHERE {_told} AND NOT ends_with(relation, '_as')),
        a AS (SELECT doc_id, src AS anchor, src_type AS type, source, {_place} AS o FROM t WHERE src_type IN {_in(L.SUBJECT_ANCHORS)} UNION ALL SELECT doc_id, dst, dst_type, source, {_place} FROM t WHERE dst_type IN {_in(L.OBJECT_ANCHORS)}),
        s AS {_event_list('a', 'anchor, type')},
        b AS {_event_list(f"(SELECT *, {_place} AS o FROM t WHERE src_type IN {_in(L.SUBJECT_ANCHORS)} AND dst_type IN {_in(L.OBJECT_ANCHORS)})", 'src, dst, dst_type')}
        SELECT doc_id, 'subgraph' AS kind, CASE WHEN type IN {_in(L.SUBJECT_ANCHORS)} THEN 'What did ' || anchor || ' do?' ELSE 'What happened in ' || anchor || '?' END AS text, events[1] AS answer, type AS answer_type, {_scored(0.3, _few, answers=_listed, level=_by_n)} FROM s
        UNION ALL SELECT doc_id, 'pair_subgraph', 'What did ' || src || ' do ' || {_case(L.OBJECT_PREPS, 'dst_type', "'in'")} || ' ' || dst || '?', events[1], dst_type, {_scored(0.3, _few, answers=_listed, level=_by_n)} FROM b""",
    "q_chain_subgraph": f"""WITH {_graph}, {_facts}, t AS (SELECT *, {_case(L.RELATION_NOUNS, 'base')} AS noun FROM f WHERE src_type IN {_in(L.SUBJECT_ANCHORS)} AND dst_type IN {_in(L.SUBJECT_ANCHORS)}),
        r AS (SELECT DISTINCT doc_id, CASE WHEN ends_with(relation, '_by') THEN dst ELSE src END AS src, CASE WHEN ends_with(relation, '_by') THEN src ELSE dst END AS anchor, noun FROM t WHERE noun IS NOT NULL),
        j AS (SELECT r.anchor, r.noun, f.*, {_place} AS o FROM r JOIN f ON f.doc_id = r.doc_id AND f.src = r.src WHERE {_told} AND dst_type IN {_in(L.OBJECT_ANCHORS)} AND contains(source, anchor)),
        s AS {_event_list('j', 'anchor, noun, dst, dst_type')}
        SELECT doc_id, 'chain_subgraph' AS kind, 'What did the ' || noun || ' of ' || anchor || ' do ' || {_case(L.OBJECT_PREPS, 'dst_type', "'in'")} || ' ' || dst || '?' AS text, events[1] AS answer, dst_type AS answer_type, {_scored(0.4, _few, hops=2, answers=_listed, s_vocab=0.5)} FROM s""",
    "q_comparison": f"""WITH {_graph}, {_facts}, b AS (SELECT *, replace(base, 'co-', '') AS vb, regexp_extract(dst, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b', 1) AS year FROM f),
        y AS (SELECT doc_id, source, src, vb, arg_min(year::INT, {_place}) AS year FROM b WHERE source <> '' AND contains(relation, '_') AND dst_type IN {_in(L.TIMES)} AND year <> '' GROUP BY 1, 2, 3, 4),
        o AS (SELECT b.doc_id, b.src, b.vb, b.dst, b.dst_type, y.year, {_place} AS o, CASE WHEN verb <> '' THEN verb ELSE b.vb END AS vt FROM b JOIN y ON y.doc_id = b.doc_id AND y.source = b.source AND y.src = b.src AND y.vb = b.vb
          WHERE b.source <> '' AND NOT contains(relation, '_') AND b.vb NOT IN {_in(L.SKIP_VERBS)} AND dst_type IN {_in(L.COMPARED_TYPES)}),
        p AS (SELECT a.doc_id, a.vt, a.dst AS a, z.dst AS b, a.dst_type, a.year AS ya, z.year AS yb, row_number() OVER (PARTITION BY a.doc_id, least(a.dst, z.dst), greatest(a.dst, z.dst) ORDER BY a.o, z.o) AS k
          FROM o a JOIN o z ON z.doc_id = a.doc_id AND z.src = a.src AND z.vb = a.vb AND z.dst_type = a.dst_type WHERE a.o < z.o AND a.dst <> z.dst AND a.year <> z.year)
        SELECT doc_id, 'comparison' AS kind, 'Which was ' || vt || ' ' || CASE WHEN early THEN 'earlier' ELSE 'later' END || ', ' || a || ' or ' || b || '?' AS text, CASE WHEN early = (ya < yb) THEN a ELSE b END AS answer, dst_type AS answer_type, {_scored(0.25, '0.25')}
        FROM p, (SELECT unnest([true, false]) AS early) WHERE k = 1""",
    "q_wh": f"""WITH {_graph}, {_facts}, t AS (SELECT *, {_place} AS o, {_vt} AS vt, NOT contains(relation, '_') AS plain, ends_with(relation, '_by') AS by_ FROM f),
        w AS (SELECT * FROM t WHERE base NOT IN {_in(L.SKIP_VERBS)} AND src_type IS NOT NULL AND dst_type IS NOT NULL AND NOT ends_with(relation, '_as')),
        mo AS (SELECT doc_id, src, relation, dst_type, list(dst ORDER BY o) AS ms FROM (SELECT doc_id, src, relation, dst_type, dst, min(o) AS o FROM t WHERE (plain OR by_) AND dst_type IS NOT NULL GROUP BY ALL) GROUP BY ALL),
        ob AS (SELECT w.*, ms, coalesce({_case(L.CASE_WORDS, 'ocase')}, {_qw.format('dst_type')}) AS word, {_case(L.PLURALS, 'dst_type')} AS noun, (plain OR by_) AND coalesce(len(ms), 0) >= 2 AND row_number() OVER (PARTITION BY w.doc_id, w.src, w.relation, w.dst_type ORDER BY o) = 1 AS many FROM w LEFT JOIN mo USING (doc_id, src, relation, dst_type) WHERE dst_type NOT IN {_in(L.OBJECT_SKIP)}),
        ms_ AS (SELECT doc_id, dst, relation, src_type, list(src ORDER BY o) AS ds FROM (SELECT doc_id, dst, relation, src_type, src, min(o) AS o FROM t WHERE plain AND src_type IS NOT NULL GROUP BY ALL) GROUP BY ALL),
        su AS (SELECT w.*, ds, {_qw.format('src_type')} AS word, plain AND coalesce(len(ds), 0) >= 2 AS shared, row_number() OVER (PARTITION BY w.doc_id, w.dst, w.relation, w.src_type ORDER BY o) = 1 AS first FROM w LEFT JOIN ms_ USING (doc_id, dst, relation, src_type)
          WHERE dst_type NOT IN {_in(L.SUBJECT_SKIP)} AND NOT (src_type IN {_in(L.PLACES)} AND dst_type IN {_in(L.PLACES)}) AND (plain OR by_))
        SELECT doc_id, 'aggregation' AS kind, 'What ' || noun || ' did ' || src || ' ' || base || '?' AS text, array_to_string(ms, ', ') AS answer, dst_type AS answer_type, {_scored(0.37, answers="array_to_string(ms, '|')")} FROM ob WHERE many AND plain AND noun IS NOT NULL
        UNION ALL SELECT doc_id, 'object', CASE WHEN NOT is_passive THEN word || ' did ' || src || ' ' || base || '?' WHEN by_ THEN CASE word WHEN 'Who' THEN 'By whom' WHEN 'What' THEN 'By what' ELSE 'By ' || lower(word) END || ' was ' || src || ' ' || vt || '?'
            WHEN prep IS NOT NULL AND NOT ((word = 'When' AND prep IN {_in(L.IMPLIED_PREPS['When'])}) OR (word = 'Where' AND prep IN {_in(L.IMPLIED_PREPS['Where'])})) THEN word || ' was ' || src || ' ' || vt || ' ' || prep || '?' ELSE word || ' was ' || src || ' ' || vt || '?' END,
          dst, dst_type, {_scored(0.2, passive='is_passive', answers="CASE WHEN many THEN array_to_string(ms, '|') END")} FROM ob WHERE NOT (many AND plain AND noun IS NOT NULL)
        UNION ALL SELECT doc_id, 'subject', CASE WHEN NOT is_passive THEN word || ' ' || vt || ' ' || dst || '?' WHEN prep IS NOT NULL THEN word || ' was ' || vt || ' ' || prep || ' ' || dst || '?' ELSE word || ' was ' || vt || '?' END,
          src, src_type, {_scored(0.2, passive='is_passive', answers="CASE WHEN shared THEN array_to_string(ds, '|') END")} FROM su WHERE NOT shared OR first""",
    "q_bridge": f"""WITH {_graph}, {_facts}, {_deg}, u AS (SELECT * FROM f WHERE {_told} AND NOT ends_with(relation, '_by') AND NOT ends_with(relation, '_as')),
        i AS (SELECT doc_id, src AS anchor, dst AS bridge, dst_type AS bridge_type, base AS v1, source AS s1, {_place} AS io FROM u WHERE src_type IN {_in(L.BRIDGE_ANCHORS)} AND dst_type IN {_in(L.BRIDGE_TYPES)}),
        j AS (SELECT u.*, i.anchor, i.bridge_type, i.v1, row_number() OVER (PARTITION BY u.doc_id, u.src, i.io ORDER BY degree DESC, u.src_ord, u.first_ord, u.ord) AS k FROM i JOIN u ON u.doc_id = i.doc_id AND u.src = i.bridge JOIN g ON g.doc_id = u.doc_id AND g.dst = u.dst
          WHERE u.dst <> i.anchor AND u.dst <> u.src AND u.source <> i.s1 AND coalesce(u.dst_type, '') NOT IN {_in(L.BRIDGE_END_SKIP)})
        SELECT doc_id, 'bridge' AS kind, 'Which ' || {_case(L.SINGULARS, 'bridge_type')} || ' did ' || anchor || ' ' || v1 || ' that ' || concat_ws(' ', {_vt}, prep) || ' ' || dst || '?' AS text, src AS answer, bridge_type AS answer_type, {_scored(0.3, '0.5', hops=2, level="'C1'")} FROM j WHERE k = 1""",
}

QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, graph_degrees, graph_neighbours, graph_summary, graph_paths, sibling_groups, mentions_resolved, question_levels)}
QUERIES |= {f"q_{name}": _kind(name) for name in ("wh", "true", "false", "which", "count", "comparison", "chain", "subgraph", "chain_subgraph", "bridge")}
