"""Queries over records in the nested forms of public data sets, built from the tables, and over what annotation makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readq.functions import numeric as M
from readq.functions import text as T
from readq.operators import annotate as A
from readq.operators import eda as E
from readq.operators import metrics as X
from readq.operators import prep as P
from readq.session import table
from readq.sources import loaders as L

_ANSWERED = "passage IS NOT NULL AND trim(passage) <> '' AND question IS NOT NULL AND trim(answer) <> ''"


def _qa(s: SparkSession, d: str) -> DataFrame:
    """Each different (rec_id, passage, question, answer) of qde with all of them."""
    return table(s, d, "qde").select("rec_id", "passage", "question", "answer").where(_ANSWERED).distinct()


def tydi_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of a multilingual extractive data set: ids that begin with a language's name."""
    rows = table(s, d, "qg_dataset").select("qg_id", "passage", "question", "answer", F.lower(F.trim("lang")).alias("l")).where(_ANSWERED + " AND l <> ''").distinct()
    name = F.when(F.col("l") == "en", "english").when(F.col("l") == "fi", "finnish").when(F.col("l") == "sw", "swahili").when(F.col("l") == "id", "indonesian").otherwise(F.col("l"))
    answers = F.struct(F.array("answer").alias("text"), F.array(F.greatest(F.instr("passage", F.col("answer")) - 1, F.lit(0))).alias("answer_start"))
    nested = rows.select(F.concat(name, F.lit("--"), F.col("qg_id").cast("string")).alias("id"), F.col("passage").alias("context"), "question", answers.alias("answers"))
    return L.extractive("tydiqa", nested).select("id", F.md5("passage").alias("passage"), "question", "answer", "answer_start", "lang")


def nq_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of an open data set with tokens, candidates and annotations."""
    words = F.split("passage", " ")
    tokens = F.concat(F.array(F.lit("<P>")), words, F.array(F.lit("</P>")))
    html = F.concat(F.array(F.lit(True)), F.transform(words, lambda _: F.lit(False)), F.array(F.lit(True)))
    nested = _qa(s, d).select(
        F.col("rec_id").alias("id"),
        F.struct(F.col("question").alias("text")).alias("question"),
        F.struct(F.struct(tokens.alias("token"), html.alias("html_token")).alias("tokens")).alias("document"),
        F.array(F.struct(F.lit(0).alias("start_token"), F.size(tokens).alias("end_token"))).alias("long_answer_candidates"),
        F.struct(
            F.array(F.struct(F.lit(-1).alias("candidate_index")), F.struct(F.lit(0).alias("candidate_index"))).alias("long_answer"),
            F.array(F.struct(F.array(F.col("answer")).alias("text")), F.struct(F.array(F.col("answer")).alias("text"))).alias("short_answers"),
        ).alias("annotations"),
    )
    return L.extractive("nq", nested, "en").select("id", F.md5("passage").alias("passage"), "question", "answer", "answer_start", "lang")


def step2_inputs(s: SparkSession, d: str) -> DataFrame:
    """The prepared inputs of a step from three multiple-choice data sets, built from the records of three sources."""

    def load(name: str) -> DataFrame:
        source = {"race_middle": "race_middle", "race_high": "race_high", "race_c": "race_c"}[name]
        rows = table(s, d, "qde").where(T.code_name("source") == source).select("rec_id", "passage", "question", "answer").where(_ANSWERED).distinct()
        options = F.array(F.lit("none"), F.col("answer"), F.lit("all"), F.lit("some"))
        if name == "race_c":
            return rows.select(F.col("passage").alias("article"), "question", options.alias("option"), F.lit(1).alias("label"))
        return rows.select(F.col("passage").alias("article"), "question", options.alias("options"), F.lit("B").alias("answer"))

    return L.prepared("step2", L.step_records("step2", load)).select(F.md5("input_text").alias("input"), F.col("target_text").alias("target"), "source")


def stats_blocks(s: SparkSession, d: str) -> DataFrame:
    """The block of statistics of passage lengths by source."""
    rows = table(s, d, "qde").where("passage IS NOT NULL").select("rec_id", "source", "passage").distinct().select(T.code_name("source").alias("source"), F.length("passage").alias("n"))
    return E.stats_block(rows, "source", F.col("n"))


def answer_shares(s: SparkSession, d: str) -> DataFrame:
    """Lengths of answers, and their share of the passage in whole percents, by split."""
    rows = table(s, d, "qde").where(_ANSWERED).select("rec_id", "split", F.length("passage").alias("p"), F.length("answer").alias("a")).distinct()
    return E.small_numbers(rows, "split", F.col("a"), F.col("a") / F.col("p")).select("split", "min", "max", F.round("mean", 6).alias("mean"), F.round("percent", 6).alias("percent"))


def last_passages(s: SparkSession, d: str) -> DataFrame:
    """Of each author the passage of the last record, then statistics over those by source."""
    rows = table(s, d, "qde").where("author IS NOT NULL AND passage IS NOT NULL AND rec_id IS NOT NULL").select("author", "rec_id", T.code_name("source").alias("source"), F.length("passage").alias("n")).distinct()
    return E.stats_block(P.keep_last(rows, ["author"], ["rec_id", "n", "source"]), "source", F.col("n"))


def student_levels(s: SparkSession, d: str) -> DataFrame:
    """Records by the level that the number of right readers of three gives."""
    right = F.floor(F.col("qa_cascade_diff") * 3 + 0.5).cast("int")
    return table(s, d, "qg_dataset").groupBy(T.student_level(right).alias("level")).agg(F.count("*").alias("n"))


def cascade_todo(s: SparkSession, d: str) -> DataFrame:
    """Records that the readers have not answered and the first judge finds demanding."""
    return P.least_demand(table(s, d, "qg_dataset").where("qa_cascade_diff IS NULL"), 0.5).select("qg_id", "annotated_at")


def level_scores(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qg_dataset").select("qg_id", "cefr", F.round(T.level_score("cefr"), 6).alias("score")).distinct()


def largest_dims(s: SparkSession, d: str) -> DataFrame:
    """The place of each vector's largest number, as a model's label from its outputs."""
    return table(s, d, "embeddings").select("vec_id", M.argmax("embedding").alias("pred"))


def answer_markers(s: SparkSession, d: str) -> DataFrame:
    """Each triple of a record with the mark whether subject or object holds the answer or is held by it."""
    rows = table(s, d, "qg_dataset").where("answer IS NOT NULL").select("qg_id", "answer", F.explode("kg_raw").alias("t")).distinct()
    mark = T.in_either(F.col("t.s"), F.col("answer")) | T.in_either(F.col("t.o"), F.col("answer"))
    return rows.groupBy("qg_id").agg(F.count("*").alias("triples"), F.count(F.when(mark, 1)).alias("marked"))


def curriculum_labels(s: SparkSession, d: str) -> DataFrame:
    """Records by their own label, EASY where they have none."""
    rows = table(s, d, "qde").select("rec_id", F.upper(T.code_name("difficulty")).alias("curriculum_difficulty")).distinct()
    return rows.groupBy(P.curriculum_label(rows).alias("label")).agg(F.count("*").alias("n"))


def judged_groups(s: SparkSession, d: str) -> DataFrame:
    """The stand-in of a grouped judge on every passage: its scores, and its new questions with the columns they take over."""
    rows = table(s, d, "qg_dataset").select("qg_id", "passage", "question", "answer").where("passage IS NOT NULL AND question IS NOT NULL").distinct()
    rows = rows.withColumn("llm_diff_judge", F.lit(None).cast("map<string, struct<passage_readability: double, passage_vocab_diff: double, question_cognitive_diff: double, question_vocab_diff: double>>"))
    out = A.annotate_groups(rows, A.word_judge, "words", "qg_id")
    score = F.col("llm_diff_judge")["words"]
    return out.select("qg_id", F.md5("passage").alias("passage"), "question", "answer", F.coalesce("generated", F.lit(False)).alias("generated"), F.round(score["passage_readability"], 6).alias("readability"), F.round(score["question_cognitive_diff"], 6).alias("demand"))


def joined_report(s: SparkSession, d: str) -> DataFrame:
    """The class report of one label against another of the same records, joined by id: the record's difficulty and that of its delivery as lines."""
    codes = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("EASY", "MEDIUM", "HARD")]), F.upper(T.code_name(c))) - 1
    truth = table(s, d, "qde").select("rec_id", codes("difficulty").cast("int").alias("label")).where("label >= 0")
    guess = table(s, d, "qde").select("rec_id", F.when(F.length("question") < 45, 0).when(F.length("question") < 60, 1).otherwise(2).alias("pred")).where("question IS NOT NULL")
    return X.confusion(X.join_predictions(truth, guess, "rec_id"))


_a = _ANSWERED
_code = "nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_block = """r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM b)
    SELECT source, max(c) AS count, round(min(n)::DOUBLE, 1) AS min, round(median(n), 1) AS median, round_even(sum(n)::DECIMAL(38, 9) / count(*), 1)::DOUBLE AS mean,
      round(max(n) FILTER (i = least(floor(c * 75 / 100), c - 1))::DOUBLE, 1) AS p75, round(max(n) FILTER (i = least(floor(c * 90 / 100), c - 1))::DOUBLE, 1) AS p90, round(max(n)::DOUBLE, 1) AS max FROM r GROUP BY 1"""
_step = "SELECT md5('generate question: difficulty: ' || '{1}' || ' context: ' || passage) AS input, question AS target, '{0}' AS source FROM (SELECT DISTINCT rec_id, passage, question, answer FROM qde WHERE " + _a + " AND " + _code.format("source") + " = '{0}')"

SQL = {
    "tydi_rows": f"""SELECT CASE l WHEN 'en' THEN 'english' WHEN 'fi' THEN 'finnish' WHEN 'sw' THEN 'swahili' WHEN 'id' THEN 'indonesian' ELSE l END || '--' || qg_id AS id, md5(passage) AS passage, question, answer, greatest(instr(passage, answer) - 1, 0) AS answer_start, CASE l WHEN 'id' THEN 'in' ELSE substr(l, 1, 2) END AS lang
        FROM (SELECT DISTINCT qg_id, passage, question, answer, lower(trim(lang)) AS l FROM qg_dataset WHERE {_a}) WHERE l <> ''""",
    "nq_rows": f"SELECT rec_id::VARCHAR AS id, md5(passage) AS passage, question, answer, greatest(instr(passage, answer) - 1, 0) AS answer_start, 'en' AS lang FROM (SELECT DISTINCT rec_id, passage, question, answer FROM qde WHERE {_a})",
    "step2_inputs": " UNION ALL ".join(_step.format(n, x) for n, x in (("race_middle", "easy"), ("race_high", "medium"), ("race_c", "hard"))),
    "stats_blocks": f"WITH b AS (SELECT {_code.format('source')} AS source, length(passage) AS n FROM (SELECT DISTINCT rec_id, source, passage FROM qde WHERE passage IS NOT NULL)), {_block}",
    "last_passages": f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY rec_id DESC) AS k FROM (SELECT DISTINCT author, rec_id, {_code.format('source')} AS source, length(passage) AS n FROM qde WHERE author IS NOT NULL AND passage IS NOT NULL AND rec_id IS NOT NULL)), b AS (SELECT source, n FROM x WHERE k = 1), {_block}",
    "answer_shares": f"SELECT split, min(a) AS min, max(a) AS max, round(avg(a), 6) AS mean, round(avg(trunc(a / p * 100)), 6) AS percent FROM (SELECT DISTINCT rec_id, split, length(passage) AS p, length(answer) AS a FROM qde WHERE {_a}) GROUP BY 1",
    "student_levels": "SELECT CASE WHEN n >= 3 THEN 'EASY' WHEN n = 2 THEN 'MEDIUM' WHEN n IS NOT NULL THEN 'HARD' END AS level, count(*) AS n FROM (SELECT floor(qa_cascade_diff * 3 + 0.5) AS n FROM qg_dataset) GROUP BY 1",
    "cascade_todo": "SELECT qg_id, annotated_at FROM qg_dataset WHERE qa_cascade_diff IS NULL AND coalesce(map_extract_value(llm_diff_judge, list_sort(map_keys(llm_diff_judge))[1]).question_cognitive_diff, 0) >= 0.5",
    "level_scores": "SELECT DISTINCT qg_id, cefr, round((coalesce(list_position(['preA1', 'A1', 'A2', 'B1', 'B2', 'C1', 'C2', 'C2+'], cefr), 1) - 1) / 7, 6) AS score FROM qg_dataset",
    "largest_dims": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings",
    "answer_markers": """SELECT qg_id, count(*) AS triples, count(*) FILTER (contains(s, a) OR contains(a, s) OR contains(o, a) OR contains(a, o)) AS marked FROM (SELECT DISTINCT qg_id, lower(answer) AS a, lower(t.s) AS s, lower(t.o) AS o, answer, t FROM (SELECT qg_id, answer, unnest(kg_raw) AS t FROM qg_dataset WHERE answer IS NOT NULL)) GROUP BY 1""",
    "curriculum_labels": f"SELECT coalesce(l, 'EASY') AS label, count(*) AS n FROM (SELECT DISTINCT rec_id, upper({_code.format('difficulty')}) AS l FROM qde) GROUP BY 1",
    "judged_groups": """WITH b AS (SELECT DISTINCT qg_id, passage, question, answer FROM qg_dataset WHERE passage IS NOT NULL AND question IS NOT NULL), w AS (SELECT *, list_distinct(string_split(lower(question), ' ')) AS q, string_split(lower(passage), ' ') AS p FROM b)
        SELECT qg_id, md5(passage) AS passage, question, answer, false AS generated, round(least(1.0, length(passage) / 4000), 6) AS readability, round(len(list_filter(q, lambda x: NOT list_contains(p, x))) / len(q), 6) AS demand FROM w
        UNION ALL SELECT NULL, md5(passage), 'What is it about?', string_split(passage, ' ')[1], true, round(least(1.0, length(passage) / 4000), 6), 0.5 FROM b GROUP BY passage""",
    "joined_report": f"""WITH t AS (SELECT rec_id, min(l) AS truth FROM (SELECT rec_id, list_position(['EASY', 'MEDIUM', 'HARD'], upper({_code.format('difficulty')})) - 1 AS l FROM qde WHERE rec_id IS NOT NULL) WHERE l >= 0 GROUP BY 1),
        p AS (SELECT rec_id, min(CASE WHEN length(question) < 45 THEN 0 WHEN length(question) < 60 THEN 1 ELSE 2 END) AS pred FROM qde WHERE question IS NOT NULL AND rec_id IS NOT NULL GROUP BY 1), j AS (SELECT * FROM t JOIN p USING (rec_id))
        SELECT x.truth, count(pred) FILTER (pred = 0) AS pred_0, count(pred) FILTER (pred = 1) AS pred_1, count(pred) FILTER (pred = 2) AS pred_2 FROM (SELECT unnest([0, 1, 2]) AS truth) x LEFT JOIN j ON j.truth = x.truth GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
