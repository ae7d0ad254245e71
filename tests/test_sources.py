"""Loaders, reports, annotation runs and the small functions beside them, on tables made here."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from readq import session
from readq.functions import numeric as M
from readq.functions import text as T
from readq.operators import annotate as A
from readq.operators import eda as E
from readq.operators import metrics as X
from readq.operators import ml
from readq.operators import prep as P
from readq.sources import loaders as L
from readq.sources import sinks as K

MAP = "map<string, struct<passage_readability: double, passage_vocab_diff: double, question_cognitive_diff: double, question_vocab_diff: double>>"


def test_multirc_nested_and_flat(spark):
    nested = spark.createDataFrame([(1, ("One. Two. Three.", [("Q1?", [0, 2]), ("Q1?", [1]), ("Q2?", [])]))], "ord INT, paragraph STRUCT<text: STRING, questions: ARRAY<STRUCT<question: STRING, sentences_used: ARRAY<INT>>>>")
    assert [(r["question"], r["focus"]) for r in P.multirc_any(nested).collect()] == [("Q1?", "One. Three.")]
    assert {(r["question"], r["source"]) for r in P.multirc_any(nested, with_focus=False).collect()} == {("Q1?", "multirc"), ("Q2?", "multirc")}
    flat = spark.createDataFrame([(1, "P", "Q?"), (2, "P", "Q?"), (3, None, None)], "ord INT, paragraph STRING, question STRING")
    assert P.multirc_any(flat).count() == 0
    assert {(r["question"], r["source"]) for r in P.multirc_any(flat, with_focus=False).collect()} >= {("Q?", "multirc_sg")}


def test_nested_open_questions(spark):
    schema = "id BIGINT, question STRUCT<text: STRING>, document STRUCT<tokens: STRUCT<token: ARRAY<STRING>, html_token: ARRAY<BOOLEAN>>>, long_answer_candidates ARRAY<STRUCT<start_token: INT, end_token: INT>>, annotations STRUCT<long_answer: ARRAY<STRUCT<candidate_index: INT>>, short_answers: ARRAY<STRUCT<text: ARRAY<STRING>>>>"
    doc = ((["<P>", "It", "rains", "."], [True, False, False, False]),)
    rows = [
        (1, ("Q",), doc, [(0, 4)], ([(-1,), (0,)], [(["no"],), (["rains"],)])),  # the first annotation has no candidate
        (2, ("Q",), doc, [(0, 4)], ([(5,)], [(["rains"],)])),  # no such candidate
        (3, ("Q",), doc, [(0, 4)], ([(0,)], [([],)])),
        (4, ("Q",), doc, [(0, 1)], ([(0,)], [(["x"],)])),  # marks only
        (5, ("Q",), doc, [(0, 4)], ([(0,)], [(["snow"],)])),
    ]
    got = {r["id"]: (r["passage"], r["answer"], r["answer_start"]) for r in L.extractive("nq", spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": ("It rains .", "rains", 3), "5": ("It rains .", "snow", 0)}


def test_registry(spark):
    rows = spark.createDataFrame([("finnish--1", "c", "q", (["a"], [0])), ("telugu--2", "c", "q", (["a"], [0])), ("english--3", "c", "q", ([], []))], "id STRING, context STRING, question STRING, answers STRUCT<text: ARRAY<STRING>, answer_start: ARRAY<INT>>")
    assert {r["lang"] for r in L.extractive("tydiqa", rows).collect()} == {"fi", "te"}
    assert {r["lang"] for r in L.extractive("squad_fi", rows).collect()} == {"fi"}
    assert L.extractive("tydiqa", rows, "fi").count() == 1
    with pytest.raises(ValueError):
        L.extractive("other", rows)
    with pytest.raises(ValueError):
        L.step_records("step9", lambda name: rows)


def test_rounding_as_binary(spark):
    rng = random.Random(4)
    values = [2.675, 0.5, 1.5, 2.5, 0.125, -0.125, 1.005, 0.285, 1e9 + 0.05, -2.675, 0.0] + [rng.uniform(-100, 100) for _ in range(500)] + [rng.randint(-9999, 9999) / 8 for _ in range(200)] + [rng.randint(0, 99999) / 1000 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in df.select(M.round_binary(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_small_functions(spark):
    df = spark.createDataFrame([("The cat sat on the mat", [0.1, 0.9, 0.9], "B1", 2), ("Kissa oli talossa ja se ei tiennyt", [], "?", 3), ("xyz", None, None, 1), (None, [float("-inf")], "C2+", None)], "t STRING, v ARRAY<DOUBLE>, level STRING, n INT")
    rows = df.select(T.detected_language("t").alias("l"), M.argmax("v").alias("a"), T.level_score("level").alias("s"), T.student_level("n").alias("d")).collect()
    assert [r["l"] for r in rows] == ["en", "fi", "en", "en"] and [r["a"] for r in rows] == [1, None, None, 0]
    assert [round(r["s"], 4) for r in rows] == [round(3 / 7, 4), 0, 0, 1] and [r["d"] for r in rows] == ["MEDIUM", "EASY", "HARD", None]
    line = df.limit(1).select(T.number_row("mean", [F.lit(1.25), F.lit(None).cast("double")], "%6.2f", 6)).first()[0]
    assert line == "mean     1.25      -"
    with pytest.raises(ValueError):
        M.hash_split("t", -0.2, 0.5)
    with pytest.raises(ValueError):
        M.hash_split("t", 0.5, 0.3, 0.1)
    M.hash_split("t", 0.7, 0.2, 0.1)


def test_shares_of_epochs_and_last_rows(spark):
    runs = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, None), (5, float("nan"))], "epoch INT, score DOUBLE")
    assert [tuple(r) for r in E.best_epoch(runs).collect()] == [(2, 0.7)] and E.best_epoch(runs.limit(0)).count() == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k STRING, o INT, t STRING")
    assert {tuple(r) for r in P.keep_last(rows, ["k"], ["o"]).collect()} == {("a", 2, "y"), (None, 1, "z")}
    assert [tuple(r) for r in X.join_predictions(spark.createDataFrame([(1, 2), (1, 1), (2, 0), (None, 1)], "id INT, label INT"), spark.createDataFrame([(1, 0), (3, 1)], "id INT, pred INT"), "id").collect()] == [(1, 1, 0)]


def test_answers_shown_and_columns_copied(spark):
    df = spark.createDataFrame([("a", ["x", "y"], None), ("a", None, ["f"]), ("a", [], ["f", "g"]), ("a", None, None)], "answer STRING, answer_list ARRAY<STRING>, answer_facts ARRAY<STRING>")
    assert [r[0] for r in df.select(P.shown_answer()).collect()] == ["x / y", "f", "(2 events, see below)", "a"]
    assert P.copy_with(df, ("answer", "lang"), generated=F.lit(True)).columns == ["answer", "generated"]
    assert df.select(P.curriculum_label(df)).distinct().collect()[0][0] == "EASY"


def test_reports(spark):
    q = spark.createDataFrame([("count", "How|many?", "2", "A1", 0.25, 0.0, 0.0, 0.5, None), ("subgraph", "What did Ann do?", "She left.", "A2", 0.5, 0.5, 0.0, 0.1, ["She left.", "She came."])], "kind STRING, text STRING, answer STRING, level STRING, s_type DOUBLE, s_local DOUBLE, s_vocab DOUBLE, s_read DOUBLE, answer_list ARRAY<STRING>")
    nodes = spark.createDataFrame([("b", None), ("a", "PERSON")], "node STRING, entity_type STRING")
    edges = spark.createDataFrame([("b", "r", "a"), ("a", "r", "b")], "src STRING, relation STRING, dst STRING")
    text = K.question_report("She left. She came", "en", q, nodes, edges)
    assert "How\\|many?" in text and "(2 events, see below)" in text and "1. She left.\n2. She came." in text
    assert text.index("| a | PERSON |") < text.index("| b |  |") and text.index("| a | r | b |") < text.index("| b | r | a |")
    assert json.loads(K.json_report({"nodes": nodes}))["nodes"][0] == {"node": "b", "entity_type": None}
    assert K.console_table(spark.createDataFrame([("a", 1.5), ("bcd", None)], "name STRING, x DOUBLE")) == "name      x\na     1.500\nbcd       -\n"
    with pytest.raises(ValueError):
        K.console_table(spark.range(3), most=2)
    marked = spark.createDataFrame([("a|cat sat", "cat"), ("dog", "cat"), ("x", None)], "t STRING, p STRING").select(K.highlighted(F.col("t"), F.col("p")))
    assert [r[0] for r in marked.collect()][:2] == ["a\\|**cat** sat", "dog"]


def test_models_are_saved(spark, tmp_path):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])] * 5, "label INT, embedding ARRAY<DOUBLE>")
    model = ml.linear_probe(df, rounds=20)
    ml.save_model(model, f"file://{tmp_path}/m")
    ml.save_model(model, f"file://{tmp_path}/m")
    assert [r["prediction"] for r in ml.load_model(f"file://{tmp_path}/m").transform(ml.as_features(df)).select("prediction").limit(2).collect()] == [0.0, 1.0]


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_grouped_judge(spark):
    rows = [(i, "the cat sat", f"did the dog{i} sit", "yes", None, "s") for i in range(10)] + [(20, "broken", "q", "a", None, "s"), (21, None, "q", "a", None, "s"), (22, "one", "one", None, {"old": (0.1, 0.2, 0.3, 0.4)}, None)]
    df = spark.createDataFrame(rows, f"id INT, passage STRING, question STRING, answer STRING, llm_diff_judge {MAP}, source STRING")

    def judge(passage, items, generates):
        if passage == "broken":
            raise RuntimeError
        assert len(items) <= 8
        return A.word_judge(passage, items, generates)

    out = A.annotate_groups(df, judge, "words", "id").collect()
    old, new = [r for r in out if not r["generated"]], [r for r in out if r["generated"]]
    by_id = {r["id"]: r["llm_diff_judge"] for r in old}
    assert len(old) == len(rows) and by_id[20] is None and by_id[21] is None and set(by_id[22]) == {"old", "words"}
    assert by_id[3]["words"]["question_cognitive_diff"] == 0.75
    assert sorted((r["passage"], r["source"], r["generated_by"], r["id"]) for r in new if r["source"]) == [("the cat sat", "s", "words", None)] and len(new) == 2


def test_runs_of_verdicts_and_readers(spark):
    items = spark.createDataFrame([(1, "p", "q?", "a", 0), (2, "p", "hard?", "a", 2)], "id INT, passage STRING, question STRING, answer STRING, label INT")
    report = A.verdict_report(items, lambda b: pd.DataFrame({"id": b["id"], "reply": ["HARD" if "hard?" in p else "EASY" for p in b["prompt"]]}), "id", "label")
    assert {r["class"]: r["f1"] for r in report.collect()}["accuracy"] == 1.0
    df = spark.createDataFrame([(1, "p", "q", "red", None, None), (2, "p", "q", "red", 0.25, None), (3, "p", "q", None, None, None)], f"id INT, passage STRING, question STRING, answer STRING, qa_cascade_diff DOUBLE, llm_diff_judge {MAP}")
    readers = {"good": lambda b: pd.DataFrame({"id": b["id"], "reply": "red"}), "bad": lambda b: pd.DataFrame({"id": b["id"], "reply": "blue"})}
    assert {r["id"]: r["qa_cascade_diff"] for r in A.cascade_run(df, readers, "id").collect()} == {1: 0.5, 2: 0.25, 3: None}
    assert {r["id"]: r["qa_cascade_diff"] for r in A.cascade_run(df, readers, "id", least=0.5).collect()} == {1: None, 2: 0.25, 3: None}
