"""Which data sets there are, how their rows become records, and which of them feed a step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.operators import prep as P

Load = Callable[[str], DataFrame]
#: Rows of each extractive data set to (id, passage, question, answer, answer_start, lang).
EXTRACTIVE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "squad": lambda df: P.squad_records(df).withColumn("lang", F.lit("en")),
    "squad_fi": lambda df: P.squad_records(df).withColumn("lang", F.lit("fi")),
    "tydiqa": P.tydi_records,
    "nq": P.nq_nested_records,
}
#: The data sets of each step of the curriculum, and the level their records stand for.
STEPS: dict[str, tuple[tuple[str, str | None], ...]] = {
    "step0": (("race_middle", "EASY"), ("race_high", "MEDIUM"), ("race_c", "HARD"), ("hotpotqa", None), ("multirc", None)),
    "step2": (("race_middle", "EASY"), ("race_high", "MEDIUM"), ("race_c", "HARD")),
    "step3": (("hotpotqa", None), ("multirc", None)),
}


def extractive(name: str, df: DataFrame, lang: str | None = None) -> DataFrame:
    """The records of a data set by its name, of one language if that is given."""
    if name not in EXTRACTIVE:
        raise ValueError(f"unknown data set {name}, known: {', '.join(sorted(EXTRACTIVE))}")
    rows = EXTRACTIVE[name](df)
    return rows if lang is None else rows.where(F.col("lang") == lang)


def step_records(step: str, load: Load) -> DataFrame:
    """The records of all data sets of a step: (passage, question, answer, difficulty, focus, source). load: the raw rows of a data set by name."""
    if step not in STEPS:
        raise ValueError(f"unknown step: {step}")
    read = {
        "race_middle": lambda df, level: P.race_records(df, level, "race_middle"),
        "race_high": lambda df, level: P.race_records(df, level, "race_high"),
        "race_c": lambda df, level: P.race_c_records(df, level),
        "hotpotqa": lambda df, level: P.hotpot_records(df, comparison_only=step == "step3"),
        "multirc": lambda df, level: P.multirc_any(df, with_focus=step == "step3"),
    }
    frames = [read[name](load(name), level) for name, level in STEPS[step]]
    wanted = ("passage", "question", "answer", "difficulty", "focus", "source")
    return P.union_all([f.select(*[(F.col(c) if c in f.columns else F.lit(None).cast("string")).alias(c) for c in wanted]) for f in frames])


def prepared(step: str, records: DataFrame) -> DataFrame:
    """(input_text, target_text, source): the prompt of the step and the question to be made; a record that lacks a part of the prompt is left out."""
    col = {c: F.col(c) for c in ("passage", "difficulty", "focus")}
    text = P.step_prompt(step, col["passage"], F.lower(col["difficulty"]), col["focus"])
    return records.select(text.alias("input_text"), F.col("question").alias("target_text"), "source").where("input_text IS NOT NULL AND target_text IS NOT NULL")
