"""Batch annotation through pluggable providers: judges, readers, generators. Work that is done is not done again.

A provider is any picklable function from a pandas DataFrame to one; it runs in the executors, batch by batch. The ones here are
deterministic stand-ins for tests, as no model is shipped; they give no claim about quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readq.functions import nested as N
from readq.functions import numeric as M
from readq.functions import text as T
from readq.operators.metrics import class_report, join_predictions
from readq.operators.prep import least_demand
from readq.session import materialise

Provider = Callable[[pd.DataFrame], pd.DataFrame]

VERDICT_PROMPT = "Passage:\n{passage}\n\nQuestion: {question}\nAnswer: {answer}\n\nHow hard is the question: EASY, MEDIUM or HARD?"


def run_provider(df: DataFrame, provider: Provider, schema: str, on_error: str = "skip") -> DataFrame:
    """The provider's rows. A batch that raises is halved until the failing row is alone; that row is skipped, or the error raised."""

    def work(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield provider(batch)
        except Exception:
            if on_error != "skip":
                raise
            if len(batch) > 1:
                half = len(batch) // 2
                yield from work(batch.iloc[:half])
                yield from work(batch.iloc[half:])

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from work(batch)

    return df.mapInPandas(every, schema)


def prompt(template: str, **columns: Column) -> Column:
    """A prompt with columns put in for the names in braces."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), columns[name]]
    return F.concat(*parts, F.lit(rest))


def verdict_prompts(df: DataFrame, longest: int = 400) -> DataFrame:
    """(id, prompt): the question whether an item is easy, medium or hard, with the passage cut to so many words."""
    return df.select(df.columns[0], prompt(VERDICT_PROMPT, passage=T.truncate_words("passage", longest), question=F.col("question"), answer=F.coalesce("answer", F.lit(""))).alias("prompt"))


def verdicts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add `pred`: 0, 1 or 2 by the reply's first level word; 1 for a reply without."""
    return replies.withColumn("pred", T.parsed_label(reply))


def todo_groups(df: DataFrame, judge: str, group: str = "passage", judged: str = "llm_diff_judge") -> DataFrame:
    """The rows of the groups in which some row lacks the judge's scores."""
    key = F.md5(F.coalesce(F.col(group), F.lit("")))
    rows = df.withColumn("__key", key)
    has = F.coalesce(F.map_contains_key(judged, F.lit(judge)), F.lit(False))
    done = rows.groupBy("__key").agg(F.every(has).alias("all")).where("all").select("__key")
    return rows.join(done, "__key", "left_anti").drop("__key")


def chunks(df: DataFrame, group: list[str], order: list[str], size: int = 8) -> DataFrame:
    """Add `chunk`, the number of the piece of `size` rows within the group, and `generates`, true in the first one."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(n / size).cast("bigint")).withColumn("generates", F.col("chunk") == 0)


def add_scores(df: DataFrame, scores: DataFrame, judge: str, keys: list[str], judged: str = "llm_diff_judge") -> DataFrame:
    """Put the scores (a struct column `score`) of the rows with the same keys into their maps under the judge's name; rows without stay."""
    joined = df.join(scores.select(*keys, F.col("score").alias("__score")), keys, "left")
    return joined.withColumn(judged, F.when(F.col("__score").isNotNull(), N.map_upsert(judged, judge, F.col("__score"))).otherwise(F.col(judged))).drop("__score").select(*df.columns)


def cascade_scores(df: DataFrame, answers: list[str], truth: str = "answer", least: float = 0.5) -> DataFrame:
    """Add `cascade`: the share of the readers whose answer has a token F1 of at least 0.5 with the true one, to four decimals; null without
    a truth."""
    right = sum(((M.token_f1(T.plain_tokens(a), T.plain_tokens(truth)) >= least).cast("int") for a in answers), F.lit(0))
    return df.withColumn("cascade", F.when(F.trim(truth) != "", F.round(right / len(answers), 4)))


def word_overlap_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a judge: the question's demand is the share of its words that the passage lacks. Columns: key, passage, question."""
    out = []
    for key, p, q in zip(batch["key"], batch["passage"], batch["question"]):
        w = set(q.lower().split())
        out.append((key, round(len(w - set(p.lower().split())) / max(1, len(w)), 4)))
    return pd.DataFrame(out, columns=["key", "demand"])


#: The scores that a judge gives: two of the passage, two of each question.
PASSAGE_SCORES = ("passage_readability", "passage_vocab_diff")
QUESTION_SCORES = ("question_cognitive_diff", "question_vocab_diff")
#: A grouped judge: (passage, [(question, answer)], whether to generate) to {"passage": scores, "items": [scores], "generated": [question, answer and scores]}.
GroupJudge = Callable[[str, list[tuple[str, str]], bool], dict]


def judge_groups(df: DataFrame, judge: GroupJudge, id_col: str, size: int = 8) -> DataFrame:
    """(id, question, answer, score, generated): what a judge says about the rows (id, passage, question, answer), a passage with up to `size`
    of its questions at a time. Scores belong to the rows by their place; items beyond the chunk's rows are left out, rows beyond the
    items get none. New questions are asked for with a passage's first chunk and have the id of its first row. A chunk whose judge
    raises is left out. Ids are to be unique; null passages are not judged."""
    kind = dict(df.dtypes)[id_col]
    names = PASSAGE_SCORES + QUESTION_SCORES
    schema = f"`{id_col}` {kind}, question STRING, answer STRING, score STRUCT<{', '.join(f'{n}: DOUBLE' for n in names)}>, generated BOOLEAN"

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(id_col), []
        try:
            said = judge(rows["passage"].iloc[0], list(zip(rows["question"], rows["answer"])), bool(rows["generates"].iloc[0]))
            of_passage = {n: said["passage"].get(n) for n in PASSAGE_SCORES}
            for key, item in zip(rows[id_col], said["items"]):
                out.append((key, None, None, of_passage | {n: item.get(n) for n in QUESTION_SCORES}, False))
            for new in said.get("generated", []) if rows["generates"].iloc[0] else []:
                out.append((rows[id_col].iloc[0], new["question"], new["answer"], of_passage | {n: new.get(n) for n in QUESTION_SCORES}, True))
        except Exception:
            out = []
        return pd.DataFrame(out, columns=[id_col, "question", "answer", "score", "generated"])

    rows = df.where("passage IS NOT NULL").select(id_col, "passage", "question", "answer", F.md5("passage").alias("__key"))
    rows = chunks(rows, ["__key"], [id_col], size)
    return rows.groupBy("__key", "chunk").applyInPandas(work, schema)


def annotate_groups(df: DataFrame, judge: GroupJudge, name: str, id_col: str, keep: tuple[str, ...] = ("passage", "kg_raw", "kg_coref", "source", "lang", "cefr"), judged: str = "llm_diff_judge", size: int = 8) -> DataFrame:
    """The rows with the judge's scores put into their maps under its name, and its new questions as further rows: these have the columns of
    `keep` that there are from the first row of their passage, generated true and generated_by the name; all else is null."""
    said = materialise(judge_groups(df, judge, id_col, size), "judged")
    scored = add_scores(df, said.where("NOT generated").select(id_col, "score"), name, [id_col], judged)
    first = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in keep if c in df.columns])
    made = said.where("generated").select(F.col(id_col).alias("__id"), "question", "answer", F.create_map(F.lit(name), F.col("score")).alias(judged))
    made = made.join(first, "__id").select(*[F.col(f"__{c}").alias(c) for c in keep if c in df.columns], "question", "answer", judged, F.lit(True).alias("generated"), F.lit(name).alias("generated_by"))
    return scored.unionByName(made, allowMissingColumns=True)


def verdict_report(items: DataFrame, provider: Provider, key: str, truth: str) -> DataFrame:
    """The class report of a model's verdicts on items (key, passage, question, answer, truth): prompts, replies (key, reply), labels, report."""
    kind = dict(items.dtypes)[key]
    asked = verdict_prompts(items.select(key, "passage", "question", "answer"))
    said = verdicts(run_provider(asked, provider, f"`{key}` {kind}, reply STRING"))
    return class_report(join_predictions(items, said, key, truth))


def cascade_run(df: DataFrame, readers: dict[str, Provider], id_col: str, least: float | None = None, done: str = "qa_cascade_diff", judged: str = "llm_diff_judge") -> DataFrame:
    """The rows with the share of readers that answer rightly, where it was missing and the first judge finds the question at least so
    demanding; other rows stay. A reader gets (id, passage, question) and gives (id, reply); what it cannot answer counts as wrong."""
    kind = dict(df.dtypes)[id_col]
    todo = df.where(F.col(done).isNull())
    todo = least_demand(todo, least, judged) if least is not None else todo
    asked = materialise(todo.select(id_col, "passage", "question", "answer"), "asked")
    for i, reader in enumerate(readers.values()):
        said = run_provider(asked.select(id_col, "passage", "question"), reader, f"`{id_col}` {kind}, reply STRING").groupBy(id_col).agg(F.min("reply").alias(f"__reply{i}"))
        asked = asked.join(said, id_col, "left")
    asked = asked.fillna("", [f"__reply{i}" for i in range(len(readers))])
    shares = cascade_scores(asked, [f"__reply{i}" for i in range(len(readers))]).groupBy(id_col).agg(F.min("cascade").alias("__share"))
    return df.join(shares, id_col, "left").withColumn(done, F.coalesce(done, "__share")).select(*df.columns)


def word_judge(passage: str, items: list[tuple[str, str]], generates: bool) -> dict:
    """Stand-in for a grouped judge: a question's demand is the share of its words that the passage lacks; the one new question is the same for
    every passage."""
    known = set(passage.lower().split(" "))
    asked = [set((q or "").lower().split(" ")) for q, _ in items]
    return {
        "passage": {"passage_readability": min(1.0, len(passage) / 4000), "passage_vocab_diff": 0.0},
        "items": [{"question_cognitive_diff": len(w - known) / len(w), "question_vocab_diff": 0.0} for w in asked],
        "generated": [{"question": "What is it about?", "answer": passage.split(" ")[0], "question_cognitive_diff": 0.5, "question_vocab_diff": 0.0}] if generates else [],
    }
