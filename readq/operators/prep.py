"""Records for training: readers of the public data sets' rows, prompts, filters, first-seen and per-group limits, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readq.functions import nested as N
from readq.functions import text as T


def _filled(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.trim(c) != "") for c in cols))


def race_records(df: DataFrame, difficulty: str, source: str) -> DataFrame:
    """Multiple choice with a letter as answer; rows whose letter names no option are left out."""
    out = df.select(F.col("article").alias("passage"), "question", N.choice_by_letter("options", "answer").alias("answer"), F.lit(difficulty).alias("difficulty"), F.lit(source).alias("source"))
    return out.where("answer IS NOT NULL")


def race_c_records(df: DataFrame, difficulty: str = "HARD", source: str = "race_c") -> DataFrame:
    """Multiple choice with a number as answer; null and impossible numbers are left out."""
    out = df.select(F.col("article").alias("passage"), "question", N.choice_by_index("option", "label").alias("answer"), F.lit(difficulty).alias("difficulty"), F.lit(source).alias("source"))
    return out.where("answer IS NOT NULL")


def hotpot_records(df: DataFrame, comparison_only: bool = False) -> DataFrame:
    """Multi-hop questions with their gold passage and the supporting sentences as focus; rows without either are left out."""
    rows = df.where(F.col("type") == "comparison") if comparison_only else df
    out = rows.select(N.gold_passage("context", "supporting_facts").alias("passage"), "question", "answer", N.focus_span("context", "supporting_facts").alias("focus"), F.lit("hotpotqa").alias("source"))
    return out.where(_filled("passage", "focus"))


def multirc_records(df: DataFrame) -> DataFrame:
    """Nested paragraphs with questions and the sentences they use, one row for each question; the first of each (text, question) stays."""
    q = df.select("ord", F.col("paragraph.text").alias("passage"), F.posexplode("paragraph.questions").alias("q_ord", "q"))
    out = q.select("ord", "q_ord", "passage", F.col("q.question").alias("question"), N.evidence(T.sentences("passage"), "q.sentences_used").alias("focus"), F.lit("multirc").alias("source"))
    key = F.concat(F.substring("passage", 1, 80), F.lit("||"), F.col("question"))
    return keep_first(out.where(F.trim("focus") != "").withColumn("key", key), ["key"], ["ord", "q_ord"]).drop("key")


def squad_records(df: DataFrame) -> DataFrame:
    """Extractive questions with their first answer; rows without one are left out."""
    out = df.select("id", F.col("context").alias("passage"), "question", F.get(F.col("answers.text"), 0).alias("answer"), F.get(F.col("answers.answer_start"), 0).alias("answer_start"))
    return out.where(_filled("answer"))


def tydi_records(df: DataFrame) -> DataFrame:
    """Extractive questions in many languages; the id begins with the language's name: english and finnish have their codes, any other the
    name's first two letters."""
    name = F.substring_index("id", "--", 1)
    lang = F.when(name == "english", "en").when(name == "finnish", "fi").otherwise(F.substring(name, 1, 2))
    return squad_records(df).withColumn("lang", lang)


def nq_nested_records(df: DataFrame) -> DataFrame:
    """Open questions in their nested form: of the annotations, the first with a short answer and a long one; the long one's tokens that
    are no HTML are the passage, and answer_start is where the answer is found in it, or 0.

    Input: id, question.text, document.tokens (token, html_token: arrays), long_answer_candidates (array of start_token, end_token),
    annotations (long_answer: array of candidate_index; short_answers: array of text: array).
    """
    each = F.arrays_zip(F.col("annotations.long_answer").alias("long"), F.col("annotations.short_answers").alias("short"))
    first = F.get(F.filter(each, lambda x: (F.size(x["short"]["text"]) > 0) & (x["long"]["candidate_index"] != -1)), 0)
    rows = df.select(F.col("id").cast("string").alias("id"), F.col("question.text").alias("question"), "document", "long_answer_candidates", first.alias("x"))
    rows = rows.select("id", "question", "document", F.get("long_answer_candidates", F.col("x.long.candidate_index")).alias("c"), F.get(F.col("x.short.text"), 0).alias("answer"))
    tokens = F.slice(F.arrays_zip(F.col("document.tokens.token").alias("t"), F.col("document.tokens.html_token").alias("h")), F.col("c.start_token") + 1, F.greatest(F.lit(0), F.col("c.end_token") - F.col("c.start_token")))
    passage = F.array_join(F.transform(F.filter(tokens, lambda x: ~x["h"]), lambda x: x["t"]), " ")
    out = rows.where("c IS NOT NULL").select("id", passage.alias("passage"), "question", "answer").where("passage <> '' AND answer <> ''")
    return out.select("*", F.greatest(F.instr("passage", F.col("answer")) - 1, F.lit(0)).alias("answer_start"), F.lit("en").alias("lang"))


def multirc_any(df: DataFrame, with_focus: bool = True) -> DataFrame:
    """MultiRC in its nested form (paragraph: text, questions), or, if the rows are flat (ord, paragraph, question, one for each answer), as
    questions without focus, so that with_focus gives none."""
    if isinstance(df.schema["paragraph"].dataType, StructType):
        if with_focus:
            return multirc_records(df)
        q = df.select("ord", F.col("paragraph.text").alias("passage"), F.posexplode("paragraph.questions").alias("q_ord", "q")).select("ord", "q_ord", "passage", F.col("q.question").alias("question"), F.lit("multirc").alias("source"))
    else:
        q = df.select("ord", F.lit(0).alias("q_ord"), F.col("paragraph").alias("passage"), "question", F.lit("multirc_sg").alias("source")).where(F.lit(not with_focus))
    key = F.concat(F.substring("passage", 1, 80), F.lit("||"), F.col("question"))
    return keep_first(q.withColumn("key", key), ["key"], ["ord", "q_ord"]).drop("key")


def curriculum_label(df: DataFrame, label: str = "curriculum_difficulty", default: str = "EASY") -> Column:
    """The record's own label for the curriculum; the default where it is null or the table has none."""
    return F.coalesce(F.col(label), F.lit(default)) if label in df.columns else F.lit(default)


def copy_with(df: DataFrame, keep: tuple[str, ...], **new: Column) -> DataFrame:
    """Of the columns named those that there are, and new ones in their place or beside them."""
    return df.select(*[c for c in keep if c in df.columns and c not in new], *[v.alias(k) for k, v in new.items()])


def shown_answer(answer: str = "answer", answers: str = "answer_list", facts: str = "answer_facts") -> Column:
    """What a report shows as the answer: the only fact, or the number of facts; else the answers of a list, else the answer."""
    n = F.coalesce(F.size(facts), F.lit(0))
    listed = F.when(F.size(answers) > 0, F.array_join(answers, " / "))
    return F.when(n == 1, F.get(facts, 0)).when(n > 1, F.concat(F.lit("("), n.cast("string"), F.lit(" events, see below)"))).otherwise(F.coalesce(listed, F.col(answer)))


def nq_records(df: DataFrame) -> DataFrame:
    """Open questions with a long answer's tokens as passage and the first short answer; HTML marks are left out.

    Input: question, tokens (array of token, html), long_start, long_end, short_start, short_end.
    """

    def span(a: str, b: str) -> Column:
        part = F.slice("tokens", F.col(a) + 1, F.greatest(F.lit(0), F.col(b) - F.col(a)))
        return F.array_join(F.transform(F.filter(part, lambda t: ~t["html"]), lambda t: t["token"]), " ")

    rows = df.where("long_start >= 0 AND short_start >= 0")
    return rows.select(span("long_start", "long_end").alias("passage"), "question", span("short_start", "short_end").alias("answer"), F.lit("nq").alias("source")).where(_filled("passage", "answer"))


# The words of the prompts.
def step_prompt(step: str, passage: Column, difficulty: Column | None = None, focus: Column | None = None) -> Column:
    """The input text of a curriculum step."""
    parts: dict[str, list] = {
        "step0": ["generate question: context: ", passage],
        "step2": ["generate question: difficulty: ", difficulty, " context: ", passage],
        "step3": ["generate question: focus: ", focus, " context: ", passage],
        "step4": ["generate question: difficulty: ", difficulty, " focus: ", focus, " context: ", passage],
    }
    if step not in parts:
        raise ValueError(f"unknown step: {step}")
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts[step]])


def model_prompt(model: str, passage: Column, answer: Column, difficulty: Column, triples: Column) -> Column:
    """The input text of a model kind, m1 to m5."""
    base = ["passage: ", passage, " answer: ", answer]
    head = ["generate question: "] if model in ("m1", "m3") else ["generate question: difficulty: ", difficulty, " "]
    tail = [" triples: ", triples] if model in ("m3", "m4") else []
    if model not in ("m1", "m2", "m3", "m4", "m5"):
        raise ValueError(f"unknown model kind: {model}")
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head + base + tail])


def encoder_text(question: Column, answer: Column) -> Column:
    return F.concat(question, F.lit(" [answer: "), answer, F.lit("]"))


def judge_score(col: Column | str, judge: str, field: str = "question_cognitive_diff") -> Column:
    """One judge's score out of the map of judges; null without it."""
    return F.try_element_at(F.col(col) if isinstance(col, str) else col, F.lit(judge))[field]


def t5_inputs(df: DataFrame, judge: str, models: tuple[str, ...] = ("m1", "m2", "m3", "m4", "m5")) -> DataFrame:
    """(qg_id, model, input_text, target_text, difficulty, lang, generated): one row for each record the judge scored and model kind."""
    score = judge_score("llm_diff_judge", judge)
    rows = df.withColumn("score", score).where("score IS NOT NULL AND passage IS NOT NULL AND answer IS NOT NULL AND question IS NOT NULL")
    label = T.difficulty_of(F.col("score"))
    texts = F.array(*[F.struct(F.lit(m).alias("model"), model_prompt(m, F.col("passage"), F.col("answer"), F.lower(label), N.triple_text("kg_coref", "kg_raw")).alias("input_text")) for m in models])
    return rows.select("qg_id", F.explode(texts).alias("x"), F.col("question").alias("target_text"), F.lower(label).alias("difficulty"), "lang", F.coalesce("generated", F.lit(False)).alias("generated")).select("qg_id", "x.*", "target_text", "difficulty", "lang", "generated")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order. It is an aggregation, combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*key).agg(first).select(*key, "r.*").select(*df.columns)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order, by an aggregation as in keep_first."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*df.columns)


def first_per_group(df: DataFrame, group: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group. Each task keeps its own first n of a group before the shuffle (Spark's window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same ones on every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_counts(df: DataFrame, longest: int = 2000, least_triples: int = 2, by: str = "source") -> DataFrame:
    """How many records each filter of the pipeline drops, in one pass: in, too_long, too_few, kept."""
    long = F.length("passage") > longest
    few = F.coalesce(F.size("kg_raw") < least_triples, F.lit(False)) & F.col("kg_raw").isNotNull()
    one = F.lit(1)
    return df.where("passage IS NOT NULL").groupBy(by).agg(
        F.count("*").alias("n_in"), F.count(F.when(long, one)).alias("too_long"), F.count(F.when(~long & few, one)).alias("too_few"), F.count(F.when(~long & ~few, one)).alias("kept")
    )


def least_demand(df: DataFrame, least: float, judged: str = "llm_diff_judge") -> DataFrame:
    """Records of which the first judge finds the question at least so demanding; no judge or no score counts as 0."""
    return df.where(F.coalesce(N.first_value(judged)["question_cognitive_diff"], F.lit(0.0)) >= least)
