"""Readers: JSON lines, text files, tables of words, with and without files that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RACE = "article STRING, question STRING, options ARRAY<STRING>, answer STRING"
RACE_C = "article STRING, question STRING, option ARRAY<STRING>, label INT"
HOTPOT = "question STRING, answer STRING, type STRING, supporting_facts STRUCT<title: ARRAY<STRING>, sent_id: ARRAY<INT>>, context STRUCT<title: ARRAY<STRING>, sentences: ARRAY<ARRAY<STRING>>>"
MULTIRC = "ord BIGINT, paragraph STRUCT<text: STRING, questions: ARRAY<STRUCT<question: STRING, sentences_used: ARRAY<INT>>>>"
SQUAD = "id STRING, context STRING, question STRING, answers STRUCT<text: ARRAY<STRING>, answer_start: ARRAY<INT>>"
QDE = "passage STRING, question STRING, answer STRING, difficulty STRING, source STRING"


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row for each line that is not blank; what is broken becomes nulls, and is kept apart by `json_lines_strict`."""
    return spark.read.schema(schema).json(path)


def json_lines_strict(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """The sound rows, and the broken lines with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema + ", __broken STRING", {"columnNameOfCorruptRecord": "__broken"}))
    return parsed.where("r.__broken IS NULL AND r IS NOT NULL").select("r.*").drop("__broken"), parsed.where("r.__broken IS NOT NULL OR r IS NULL").select("value", "file")


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths that exist, and those that are missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, missing = [], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        (there if path.getFileSystem(conf).exists(path) else missing).append(p)
    return there, missing


def json_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of the files that exist; files that are missing are passed over. None at all gives an empty table."""
    there, _ = existing(spark, paths)
    return json_lines(spark, there, schema) if there else spark.createDataFrame([], schema)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row for each text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"))


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a CSV file with a header; words in lower case, the largest frequency of each."""
    rows = spark.read.csv(path, header=True, schema="word STRING, freq DOUBLE")
    return rows.where("word IS NOT NULL").groupBy(F.lower(F.trim("word")).alias("word")).agg(F.max("freq").alias("freq"))


def corpus_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(word, freq, zipf) counted from the texts themselves."""
    from readq.functions import text as T

    words = df.select(F.explode(T.tokens(text)).alias("word")).where(~F.contains(F.col("word"), F.lit("'"))).groupBy("word").agg(F.count("*").alias("n"))
    freq = F.col("n") / F.lit(words.agg(F.sum("n")).first()[0] or 1)
    return words.select("word", freq.alias("freq"), (F.log10(freq) + 9).alias("zipf"))
