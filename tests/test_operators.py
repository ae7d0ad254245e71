"""Operators on small hand-made tables: readers, prompts, graphs, mentions, annotation, sinks, streaming."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readq.functions import nested as N
from readq.functions import numeric as M
from readq.functions import text as T
from readq.operators import annotate as A
from readq.operators import embeddings as V
from readq.operators import graph as G
from readq.operators import metrics as X
from readq.operators import ordered
from readq.operators import prep as P
from readq.operators import questions as Q
from readq.sources import readers, sinks
from readq.streaming import incremental


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values)).select(column.alias("x")).first()["x"]


def test_words_and_sentences(spark):
    assert one(spark, T.tokens("t"), t="Don't STOP, Zoé 7!") == ["don't", "stop", "zo"]
    assert one(spark, T.word_count("t"), t=" a b  c\n") == 3
    assert one(spark, T.sentence_count("t"), t="One. Two? Three") == 3
    assert one(spark, T.sentence_count_by_marks("t"), t="...") == 1
    assert one(spark, T.lix("t"), t="") == 0.0
    assert one(spark, T.first_year("t"), t="in 99 or 1987, not 12345") == 1987
    assert one(spark, T.parsed_label("t"), t="I think: hard") == 2
    assert one(spark, T.without_fence("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.truncate_words("t", 2), t="a b c") == "a b"


@pytest.mark.parametrize("q,kind,ordinal,score", [("Whose is it?", "who", 7, 0.2), ("How many?", "how many", 5, 0.4), ("what?", "what", 9, 0.25), ("Is it so?", "yes/no", 9, 0.5), ("", "other", 9, 0.5)])
def test_question_kinds(spark, q, kind, ordinal, score):
    assert one(spark, T.question_kind("q"), q=q) == kind
    assert one(spark, T.wh_ordinal("q"), q=q) == ordinal
    assert one(spark, T.qtype_score("q"), q=q) == score


def test_canonical_text_ignores_formatting(spark):
    a, b = one(spark, T.canonical("t"), t="A​b, C-d!  e\n"), one(spark, T.canonical("t"), t="ab cde")
    assert a == b == "abcde"
    assert one(spark, T.canonical_key("t"), t=" .​ ") is None
    assert one(spark, T.words_text("t"), t="Don’t  STOP​-it") == "dont stop it"


def test_md5_split_is_the_big_number(spark):
    import hashlib

    for t in ("", "abc", "zoë"):
        assert one(spark, M.md5_mod("t", 100), t=t) == int(hashlib.md5(t.encode()).hexdigest(), 16) % 100


def test_readers(spark, tmp_path):
    race = spark.createDataFrame([("p", "q", ["w", "x"], "B"), ("p", "q", ["w"], "D"), ("p", "q", ["w"], "")], readers.RACE)
    assert [r["answer"] for r in P.race_records(race, "EASY", "race_middle").collect()] == ["x"]
    race_c = spark.createDataFrame([("p", "q", ["w", "x"], 1), ("p", "q", ["w"], None), ("p", "q", ["w"], -1), ("p", "q", ["w"], 5)], readers.RACE_C)
    assert [r["answer"] for r in P.race_c_records(race_c).collect()] == ["x"]
    hotpot = spark.createDataFrame([("q", "a", "comparison", (["B"], [1]), (["A", "B"], [["a0"], ["b0 ", " b1"]])), ("q", "a", "bridge", (["Z"], [0]), (["A"], [["a0"]]))], readers.HOTPOT)
    got = P.hotpot_records(hotpot, comparison_only=True).collect()
    assert [(r["passage"], r["focus"]) for r in got] == [("b0   b1", "b1")]
    multi = spark.createDataFrame([(0, ("One. Two. Three.", [("q1", [0, 2, 9]), ("q2", [])])), (1, ("One. Two. Three.", [("q1", [1])]))], readers.MULTIRC)
    assert [(r["question"], r["focus"]) for r in P.multirc_records(multi).collect()] == [("q1", "One. Three.")]
    squad = spark.createDataFrame([("1", "c", "q", (["a", "b"], [0, 1])), ("2", "c", "q", ([], []))], readers.SQUAD)
    assert [r["answer"] for r in P.squad_records(squad).collect()] == ["a"]
    path = tmp_path / "a.jsonl"
    path.write_text('{"passage": "p", "question": "q"}\n\n{"passage": "bro\n')
    good, bad = readers.json_lines_strict(spark, str(path), readers.QDE)
    assert good.count() == 1 and bad.count() == 1
    assert readers.json_files(spark, [str(path), str(tmp_path / "none.jsonl")], readers.QDE).where("passage = 'p'").count() == 1
    assert readers.json_files(spark, [str(tmp_path / "none.jsonl")], readers.QDE).count() == 0


def test_prompts(spark):
    assert one(spark, P.step_prompt("step4", F.col("p"), F.col("d"), F.col("f")), p="P", d="EASY", f="F") == "generate question: difficulty: EASY focus: F context: P"
    assert one(spark, P.model_prompt("m4", F.col("p"), F.col("a"), F.col("d"), F.col("t")), p="P", a="A", d="easy", t="T") == "generate question: difficulty: easy passage: P answer: A triples: T"
    with pytest.raises(ValueError):
        P.step_prompt("step9", F.lit(""))
    assert one(spark, N.sentence_window(T.sentences("t"), F.lit(5), 1), t="One. Two. Three. Four.") == "One. Two. Three."


def test_prefix_sum_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = ordered.prefix_sum(df, [F.col("k"), F.col("id")], F.col("id")).orderBy("k", "id").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["id"]
    assert ordered.prefix_sum(df.limit(0), [F.col("k")], F.col("id")).count() == 0


TRIPLES = "doc_id BIGINT, ord INT, subject STRING, subject_type STRING, relation STRING, object STRING, object_type STRING, source STRING, verb_text STRING, is_passive BOOLEAN, object_surface STRING, object_case STRING, sentence_idx INT, coref_distance INT, source_depth INT, answer_depth INT"


def triples(spark, rows):
    full = [(1, i, s, st, r, o, ot, src, v, False, o, "", i, 0, 0, 1) for i, (s, st, r, o, ot, src, v) in enumerate(rows)]
    return spark.createDataFrame(full, TRIPLES)


NOKIA = [
    ("Ada Berg", "PERSON", "found", "Nolia", "ORG", "Ada Berg founded Nolia in 1901.", "founded"),
    ("Ada Berg", "PERSON", "found_in", "1901", "DATE", "Ada Berg founded Nolia in 1901.", "founded"),
    ("Ada Berg", "PERSON", "found", "Telma", "ORG", "Ada Berg founded Telma in 1920.", "founded"),
    ("Ada Berg", "PERSON", "found_in", "1920", "DATE", "Ada Berg founded Telma in 1920.", "founded"),
    ("she", None, "lead", "Berg", "PERSON", "she led it.", "led"),
]


def test_graph(spark):
    t = triples(spark, NOKIA)
    assert {(r["node"], r["degree"]) for r in G.degrees(t).collect()} >= {("Ada Berg", 4), ("Nolia", 1)}
    assert G.siblings(G.edges(t)).where("type = 'ORG'").first()["members"] == ["Nolia", "Telma"]
    assert G.paths(G.edges(triples(spark, [("a", None, "x", "b", None, "", ""), ("b", None, "y", "c", None, "", ""), ("c", None, "z", "a", None, "", "")])), 3).groupBy("n_hops").count().orderBy("n_hops").collect() == [(1, 3), (2, 3)]
    fixed = {r["ord"]: (r["subject"], r["object"], r["coref_distance"]) for r in G.resolve_mentions(t).collect()}
    assert fixed[4] == ("Ada Berg", "Ada Berg", 4) and fixed[0] == ("Ada Berg", "Nolia", 0)
    assert G.resolve_mentions(t.limit(0)).count() == 0


def test_questions(spark):
    t = triples(spark, NOKIA)
    facts = Q.fact_table(t)
    texts = lambda df: {(r["text"], r["answer"]) for r in df.collect()}
    assert ("What organizations did Ada Berg found?", "Nolia, Telma") in texts(Q.wh_questions(facts))
    assert texts(Q.count_questions(facts)) == {("How many organizations did Ada Berg found?", "2")}
    assert texts(Q.which_questions(facts)) == {("Which organization did Ada Berg found in 1901?", "Nolia"), ("Which organization did Ada Berg found in 1920?", "Telma")}
    assert texts(Q.comparison_questions(facts)) == {("Which was founded earlier, Nolia or Telma?", "Nolia"), ("Which was founded later, Nolia or Telma?", "Telma")}
    assert ("Did Ada Berg found Nolia?", "Yes") in texts(Q.true_claims(facts))
    got = Q.assemble(Q.all_questions(t), spark.createDataFrame([(1, "A text.")], "doc_id BIGINT, text STRING"), limit=3).collect()
    assert [r["rank"] for r in got] == [1, 2, 3]
    assert Q.all_questions(t.limit(0)).count() == 0 and Q.all_questions(t, "sv").count() == 0
    finnish = {r["text"] for r in Q.all_questions(t, "fi").collect()}
    assert {"Mitä organisaatioita Ada Berg found?", "Montako organisaatioita Ada Berg found?", "Foundedko Ada Berg Nolia?", "Kumpi tapahtui aikaisemmin, Nolia vai Telma?", "Mitä Ada Berg teki?", "Minkä organisaatio Ada Berg found 1901?"} <= finnish
    assert one(spark, Q.with_clitic(F.col("v")), v="löysi") == "Löysikö" and one(spark, Q.with_clitic(F.col("v")), v="osti") == "Ostiko"


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, None)], "truth INT, pred INT")
    assert X.confusion(df).orderBy("truth").collect()[0][1:] == (1, 1, 0)
    report = {r["class"]: r for r in X.class_report(df).collect()}
    assert report["0"]["recall"] == 0.5 and report["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert X.spearman(spark.createDataFrame([(1, 2), (2, 4), (3, 6), (3, 6)], "a INT, b INT"), "a", "b").first()["rho"] == pytest.approx(1)


def test_embeddings(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "EASY"), (2, [0.9, 0.1], "EASY"), (3, [0.0, 1.0], "HARD"), (4, [0.5, 0.5], "MEDIUM")], "id BIGINT, embedding ARRAY<DOUBLE>, label STRING")
    assert [r["id"] for r in V.nearest(df, df.where("id = 1"), n=2).orderBy("rank").collect()] == [2, 4]
    t = {r["anchor"]: (r["positive"], r["negative"]) for r in V.triplets(df, mode="ordinal").collect()}
    assert t[1] == (4, 3) and t[3][0] == 4 and t[3][1] in (1, 2)
    assert V.triplet_losses(V.triplets(df), df).count() == 4


def test_neighbours_without_length_and_repeats(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (None, [1.0, 0.0]), (6, [-1.0, 0.0])], "id BIGINT, embedding ARRAY<DOUBLE>")
    got = {(r["query_id"], r["id"]): r["similarity"] for r in V.nearest(df, df.where("id IN (1, 3)"), n=9).collect()}
    assert got == {(1, 2): 1.0, (1, 6): -1.0}
    assert V.nearest(df, df.limit(0)).count() == 0 and V.VectorIndex(df.limit(0)).search(df).count() == 0


def test_index_finds_most_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    vectors = centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id BIGINT, embedding ARRAY<DOUBLE>")
    index = V.VectorIndex(df, cells=32)
    assert index.rows.count() == 3000
    assert index.recall(df, df.where("id % 50 = 0"), n=10, probes=8) >= 0.9
    assert index.recall(df, df.where("id % 50 = 0"), n=10, probes=32) == 1.0


def test_mixed_triplets(spark):
    df = spark.range(300).select("id", F.element_at(F.array(F.lit("EASY"), F.lit("MEDIUM"), F.lit("HARD")), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    same, ordinal, mixed = ({r["anchor"]: (r["positive"], r["negative"]) for r in V.triplets(df, mode=m).collect()} for m in ("same_class", "ordinal", "mixed"))
    assert len(mixed) == 300 and all(mixed[k] in (same[k], ordinal[k]) for k in mixed)
    ends = [k for k in mixed if k % 3 != 1]
    assert 60 < sum(mixed[k] == ordinal[k] for k in ends) < 140 and 60 < sum(mixed[k] == same[k] for k in ends) < 140
    with pytest.raises(ValueError):
        V.triplets(df, mode="other")


def test_annotation(spark):
    df = spark.createDataFrame([(1, "p", {"a": 1.0}), (2, "p", None), (3, "r", {"a": 2.0, "b": 1.0})], "id INT, passage STRING, llm_diff_judge MAP<STRING, DOUBLE>")
    assert sorted(r["id"] for r in A.todo_groups(df, "a").collect()) == [1, 2]
    new = spark.createDataFrame([(2, 9.0)], "id INT, score DOUBLE")
    assert {r["id"]: r["llm_diff_judge"] for r in A.add_scores(df, new, "a", ["id"]).collect()}[2] == {"a": 9.0}

    def fails_on_two(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["id"] == 2).any():
            raise RuntimeError
        return batch[["id"]]

    assert sorted(r["id"] for r in A.run_provider(df.select("id"), fails_on_two, "id INT").collect()) == [1, 3]
    scored = A.cascade_scores(spark.createDataFrame([("the red cat", "red cat", "dog", "")], "answer STRING, m1 STRING, m2 STRING, m3 STRING"), ["m1", "m2", "m3"])
    assert scored.first()["cascade"] == 0.3333
    assert A.verdict_prompts(spark.createDataFrame([(1, "a b c", "q", None)], "id INT, passage STRING, question STRING, answer STRING"), 2).first()["prompt"].startswith("Passage:\na b\n")


def test_sinks_and_streaming(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "x|y"), (2, "test", None)], "id INT, split STRING, t STRING")
    sinks.json_by(df, str(tmp_path / "out"), "split")
    assert json.loads(next((tmp_path / "out/split=train").glob("*.json")).read_text()) == {"id": 1, "t": "x|y"}
    assert sinks.new_version(df, str(tmp_path / "v")).endswith("v1") and sinks.new_version(df.where("id = 1"), str(tmp_path / "v")).endswith("v2")
    assert sinks.latest_version(spark, str(tmp_path / "v")).count() == 1
    assert "x\\|y" in sinks.markdown(df.orderBy("id"), "T")
    run = lambda: incremental.annotate_stream(spark, str(tmp_path / "in"), "id INT, split STRING, t STRING", str(tmp_path / "done"), str(tmp_path / "cp"), lambda x: x.select("id", F.length("t").alias("n")), "id")
    df.write.parquet(str(tmp_path / "in"))
    run()
    df.union(spark.createDataFrame([(3, "val", "zz")], df.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [1, 2, 3]


def word(i, text, lemma, upos, head, deprel, feats=None):
    return (i, text, lemma, upos, feats, head, deprel)


def test_extraction_from_parses(spark):
    from readq.operators import extract as E

    founded = (
        "Ada and Ben founded Nolia in Oslo .",
        [word(1, "Ada", "Ada", "PROPN", 4, "nsubj"), word(2, "and", "and", "CCONJ", 3, "cc"), word(3, "Ben", "Ben", "PROPN", 1, "conj"), word(4, "founded", "found", "VERB", 0, "root"),
         word(5, "Nolia", "Nolia", "PROPN", 4, "obj"), word(6, "in", "in", "ADP", 7, "case"), word(7, "Oslo", "Oslo", "PROPN", 4, "obl")],
        [([1], "PERSON", "Ada"), ([3], "PERSON", "Ben"), ([5], "ORG", "Nolia"), ([7], "GPE", "Oslo")],
    )
    copula = (
        "She is the head of Nolia .",
        [word(1, "She", "she", "PRON", 4, "nsubj"), word(2, "is", "be", "AUX", 4, "cop"), word(3, "the", "the", "DET", 4, "det"), word(4, "head", "head", "NOUN", 0, "root"), word(5, "of", "of", "ADP", 6, "case"), word(6, "Nolia", "Nolia", "PROPN", 4, "nmod")],
        [([6], "ORG", "Nolia")],
    )
    passive = (
        "Nolia was sold by a big company (1999)",
        [word(1, "Nolia", "Nolia", "PROPN", 3, "nsubj:pass"), word(2, "was", "be", "AUX", 3, "aux:pass"), word(3, "sold", "sell", "VERB", 0, "root", "Voice=Pass"), word(4, "by", "by", "ADP", 6, "case"), word(5, "big", "big", "ADJ", 6, "amod"), word(6, "company", "company", "NOUN", 3, "obl:agent"),
         word(7, "1999", "1999", "NUM", 6, "appos")],
        [([1], "ORG", "Nolia")],
    )
    parsed = spark.createDataFrame([(1, [founded, copula, passive], [("Ada Berg", ["She"])]), (2, None, None), (3, [], None)], E.PARSE)
    rows = E.extract(parsed, resolve=True).orderBy("ord").collect()
    assert [(r["subject"], r["relation"], r["object"]) for r in rows] == [
        ("Ada", "found", "Nolia"), ("Ada", "found_in", "Oslo"), ("Ben", "found", "Nolia"), ("Ben", "found_in", "Oslo"), ("Ada Berg", "be", "head"), ("Ada Berg", "be_of", "Nolia"),
        ("Nolia", "sell_by", "big company"), ("company", "year", "1999"),
    ]
    assert rows[6]["is_passive"] and rows[4]["coref_distance"] == 1 and rows[1]["answer_depth"] == 1 and rows[0]["object_type"] == "ORG"
    loop = ("a b", [word(1, "a", "a", "VERB", 2, "conj"), word(2, "b", "b", "VERB", 1, "conj")], None)
    assert E.extract(spark.createDataFrame([(1, [loop], None)], E.PARSE)).count() == 0


def test_verb_variants(spark):
    from readq.operators import variants

    q = spark.createDataFrame([(1, "Who founded Nolia?", "founded", "found", "VBD"), (2, "Who did it?", "did", "do", "VBD")], "question_id INT, text STRING, verb_text STRING, verb_lemma STRING, verb_form STRING")
    near = spark.createDataFrame([("founded", "start", 0.9, "A1"), ("founded", "create", 0.8, "A2"), ("founded", "found", 0.7, "C1"), ("did", "make", 0.9, "A1")], "verb STRING, other STRING, similarity DOUBLE, band STRING")
    forms = spark.createDataFrame([("start", "VBD", "started"), ("create", "VBD", "created")], "lemma STRING, form STRING, text STRING")
    got = {(r["question_id"], r["text"]) for r in variants.question_variants(q, near, forms).collect()}
    assert got == {(1, "Who started Nolia?"), (1, "Who created Nolia?"), (1, "Who found Nolia?")}
    vectors = spark.createDataFrame([("run", [1.0, 0.0], True), ("walk", [0.9, 0.1], False), ("tree", [0.0, 1.0], False)], "word STRING, vec ARRAY<DOUBLE>, is_verb BOOLEAN")
    freqs = spark.createDataFrame([("walk", 0.0005), ("tree", 0.1)], "word STRING, freq DOUBLE")
    assert [(r["verb"], r["other"], r["band"]) for r in variants.verb_neighbours(vectors, freqs).collect()] == [("run", "walk", "A2")]


def _facts_of(spark, rows):
    """Triples of one document: (subject, type, relation, object, type, source, depths)."""
    cols = "doc_id BIGINT, ord INT, subject STRING, subject_type STRING, relation STRING, object STRING, object_type STRING, source STRING, verb_text STRING, is_passive BOOLEAN, object_surface STRING, object_case STRING, sentence_idx INT, coref_distance INT, source_depth INT, answer_depth INT"
    return Q.fact_table(spark.createDataFrame([(1, i, s, st, r, o, ot, src, v, p, "", "", 0, c, 0, 0) for i, (s, st, r, o, ot, src, v, p, c) in enumerate(rows)], cols))


def test_comparisons_by_year(spark):
    told = "Ann built Alpha in 1901."
    later = "Ann built Beta in 1950."
    facts = _facts_of(spark, [
        ("Ann", "PERSON", "build", "Alpha", "ORG", told, "built", False, 0), ("Ann", "PERSON", "build_in", "1901", "DATE", told, "built", False, 0),
        ("Ann", "PERSON", "build", "Beta", "ORG", later, "built", False, 0), ("Ann", "PERSON", "build_in", "1950", "DATE", later, "built", False, 0),
    ])
    got = {r["text"]: r["answer"] for r in Q.comparison_questions(facts).collect()}
    assert got == {"Which was built earlier, Alpha or Beta?": "Alpha", "Which was built later, Alpha or Beta?": "Beta"}


def test_chains_are_as_local_as_their_second_edge(spark):
    facts = _facts_of(spark, [("Acme", "ORG", "found", "Ann", "PERSON", "s", "founded", False, 0), ("Ann", "PERSON", "move_to", "Oslo", "GPE", "s", "moved", True, 3)])
    rows = Q.chain_questions(facts).collect()
    assert rows and all(abs(r["s_local"] - 1 / 3) < 1e-9 and r["s_vocab"] == 0.0 and r["hop_count"] == 2 for r in rows)


def test_largest_earlier_value_over_chunks(spark, monkeypatch):
    rows = [("a", i, (i * 7919) % 1000 if i % 3 else None) for i in range(200)] + [("b", 5, 1), ("b", 5, 9), ("b", 50, None)]
    df = spark.createDataFrame(rows, "k STRING, o INT, v INT")
    want = sorted((k, o, max((x for j, p, x in rows if j == k and p < o and x is not None), default=None)) for k, o, _ in rows if (k, o) != ("b", 5))
    for chunk in (1, 7, 10_000):
        monkeypatch.setattr(G, "CHUNK", chunk)
        got = sorted(tuple(r) for r in G.earlier_max(df, ["k"], "o", "v").collect() if (r["k"], r["o"]) != ("b", 5))
        assert [(k, o, -1 if v is None else v) for k, o, v in got] == [(k, o, -1 if v is None else v) for k, o, v in want]
