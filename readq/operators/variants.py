"""Variants of a question with its main verb replaced by a word of another frequency band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readq.functions import numeric as M
from readq.operators.prep import first_per_group

BANDS = ("A1", "A2", "B1", "B2", "C1")
# Verbs that carry no meaning of their own stay.
LIGHT_VERBS = ("do", "be", "have", "get")


def verb_neighbours(vectors: DataFrame, freqs: DataFrame, lang: str = "en", least: float = 0.5, n: int = 20) -> DataFrame:
    """(verb, other, similarity, band): the n most similar words of each verb, at least `least` similar, with their bands.
    vectors: (word, vec, is_verb); the verbs are the stated queries, compared with all words block by block."""
    from readq.operators.embeddings import nearest

    # The search knows rows by numbers: a hash of 64 bits stands for the word.
    keyed = vectors.select(F.xxhash64("word").alias("id"), "word", F.col("vec").alias("embedding"), "is_verb")
    near = nearest(keyed, keyed.where("is_verb"), n=n, least=least)
    words = keyed.groupBy("id").agg(F.min("word").alias("word"))
    near = near.join(words.withColumnRenamed("word", "__other"), "id").join(words.select(F.col("id").alias("query_id"), F.col("word").alias("__verb")), "query_id")
    near = near.select(F.col("__verb").alias("query_id"), F.col("__other").alias("id"), "similarity")
    bands = freqs.groupBy(F.lower("word").alias("other")).agg(M.frequency_band(F.max("freq"), lang).alias("band"))
    return near.select(F.col("query_id").alias("verb"), F.col("id").alias("other"), "similarity").join(bands, "other").where("band IS NOT NULL")


def question_variants(questions: DataFrame, neighbours: DataFrame, forms: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, band, text): for each band the question with the most similar verb of that band; without one, of a band at most two
    away and more than 0.55 similar. At most `most` for each question, and no text twice.

    questions: (question_id, text, verb_text, verb_lemma, verb_form); forms: (lemma, form, text), how a verb is inflected.
    """
    usable = questions.where(~F.lower("verb_lemma").isin(*LIGHT_VERBS) & F.col("verb_text").isNotNull())
    number = lambda c: F.array_position(F.array(*[F.lit(b) for b in BANDS]), c)
    wanted = usable.withColumn("wanted", F.explode(F.array(*[F.lit(b) for b in BANDS])))
    found = wanted.join(neighbours, F.lower(F.col("verb_text")) == F.col("verb")).withColumn("away", F.abs(number(F.col("wanted")) - number(F.col("band"))))
    found = found.where((F.col("away") == 0) | ((F.col("away") <= 2) & (F.col("similarity") > 0.55)))
    best = first_per_group(found, ["question_id", "wanted"], [F.col("away"), F.desc("similarity"), "other"], 1)
    inflected = best.join(forms.select(F.col("lemma").alias("other"), F.col("form").alias("verb_form"), F.col("text").alias("shape")), ["other", "verb_form"], "left")
    pattern = F.concat(F.lit(r"(?i)\b\Q"), "verb_text", F.lit(r"\E\b"))
    text = F.regexp_replace(F.col("text"), pattern, F.coalesce("shape", "other"))
    made = inflected.select("question_id", F.col("wanted").alias("band"), text.alias("variant"), "text").where("variant <> text")
    once = first_per_group(made, ["question_id", "variant"], ["band"], 1)
    w = Window.partitionBy("question_id").orderBy("band")
    return once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("question_id", "band", F.col("variant").alias("text"))
