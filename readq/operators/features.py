"""The 14 features of a question on a passage, and averages over word frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readq.functions import text as T

FEATURES = (
    "q_n_tokens", "q_avg_wlen", "q_wh_type", "q_avg_zipf", "q_frac_rare", "p_n_tokens", "p_n_sents", "p_avg_slen", "p_ttr",
    "p_avg_zipf", "a_n_tokens", "a_avg_zipf", "q_p_overlap", "a_in_passage",
)
#: Words rarer than this count as rare.
RARE_ZIPF = 3.0
#: A word table of up to so many rows is broadcast; a larger one is joined by word.
MAP_ROWS = 200_000


def _ratio(numerator: Column, n: Column) -> Column:
    return F.when(n > 0, numerator / n).otherwise(0.0)


def text_features(df: DataFrame, passage: str = "passage", question: str = "question", answer: str = "answer") -> DataFrame:
    """Add the features that need no word frequencies. Null texts count as empty."""
    p, q, a = (F.coalesce(F.col(c), F.lit("")) for c in (passage, question, answer))
    tokens = df.withColumns({"__q": T.tokens(q), "__p": T.tokens(p), "__a": T.tokens(a)})
    n = {k: F.size(f"__{k}").cast("bigint") for k in "qpa"}
    content = T.content_words(F.col("__q"))
    shared = F.size(F.filter(content, lambda t: F.array_contains(F.col("__p"), t)))
    sents = T.sentence_count_by_marks(p)
    return tokens.withColumns(
        {
            "q_n_tokens": n["q"],
            "q_avg_wlen": _ratio(F.aggregate("__q", F.lit(0), lambda s, t: s + F.length(t)), n["q"]),
            "q_wh_type": T.wh_ordinal(q),
            "p_n_tokens": n["p"],
            "p_n_sents": sents,
            "p_avg_slen": n["p"] / sents,
            "p_ttr": _ratio(F.size(F.array_distinct("__p")), n["p"]),
            "a_n_tokens": n["a"],
            "q_p_overlap": _ratio(shared, F.size(content)),
            "a_in_passage": T.contains_text(p, a).cast("double"),
        }
    ).drop("__q", "__p", "__a")


def word_table(freq: DataFrame) -> DataFrame:
    """(word, zipf): lower-case words with their frequency on the zipf scale; a missing one is taken from freq, log10 of it plus 9."""
    zipf = F.coalesce("zipf", F.when(F.col("freq") > 0, F.log10("freq") + 9), F.lit(0.0))
    return freq.where("word IS NOT NULL").groupBy(F.lower(F.trim("word")).alias("word")).agg(F.max(zipf).alias("zipf"))


def zipf_stats(df: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """(id, n_words, avg_zipf, frac_rare) over the tokens without apostrophes; unknown words have zipf 0.

    The tokens of all texts are counted per text first, so the join carries each different word of a text once.
    """
    each = df.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("word")).where(~F.col("word").contains("'")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    small = words.limit(MAP_ROWS + 1).count() <= MAP_ROWS
    joined = each.join(F.broadcast(words) if small else words, "word", "left")
    z = F.coalesce("zipf", F.lit(0.0))
    # Decimals, so that the sum does not depend on the order of its parts.
    exact = (z.cast("decimal(12,6)") * F.col("n").cast("decimal(12,0)")).cast("decimal(30,6)")
    got = joined.groupBy(id_col).agg(F.sum("n").alias("n_words"), F.sum(exact).cast("double").alias("__sum"), F.sum(F.when(z < RARE_ZIPF, F.col("n")).otherwise(0)).alias("__rare"))
    every = df.select(id_col).join(got, id_col, "left")
    n = F.coalesce("n_words", F.lit(0))
    return every.select(id_col, n.alias("n_words"), _ratio(F.col("__sum"), n).alias("avg_zipf"), _ratio(F.col("__rare"), n).alias("frac_rare"))


def feature_table(df: DataFrame, words: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """One row for each record with all features in their order; ids are to be unique, a null id gives no row.

    With a small word table the words of all three texts meet it at once, and one aggregation by id brings each record together
    again: it is combined before the shuffle, where the rows of a record still lie together, so one row for each record is shuffled.
    """
    out = text_features(df.where(F.col(id_col).isNotNull()))
    if words.limit(MAP_ROWS + 1).count() > MAP_ROWS:
        for short, col in (("q", "question"), ("p", "passage"), ("a", "answer")):
            stats = zipf_stats(df, id_col, col, words).withColumnRenamed("avg_zipf", f"{short}_avg_zipf")
            stats = stats.withColumnRenamed("frac_rare", "q_frac_rare").drop("n_words") if short == "q" else stats.drop("n_words", "frac_rare")
            out = out.join(stats, id_col)
        return out.select(id_col, *FEATURES)
    plain = [c for c in FEATURES if "zipf" not in c and c != "q_frac_rare"]
    fields = {"q": "question", "p": "passage", "a": "answer"}

    def named(field: str, col: str) -> Column:
        return F.transform(F.coalesce(T.tokens(col), F.array().cast("array<string>")), lambda w: F.struct(F.lit(field).alias("field"), w.alias("word")))

    each = F.concat(*[named(k, c) for k, c in fields.items()])
    rows = out.select(id_col, *plain, F.explode_outer(each).alias("x")).select(id_col, *plain, "x.field", "x.word")
    # Millionths as whole numbers, so that the sum does not depend on the order of its parts.
    known = words.select("word", (F.col("zipf").cast("decimal(12,6)") * 1_000_000).cast("bigint").alias("__zipf"))
    rows = rows.join(F.broadcast(known), "word", "left")
    counted = F.col("word").isNotNull() & ~F.contains(F.coalesce("word", F.lit("")), F.lit("'"))
    z = F.coalesce("__zipf", F.lit(0))
    sums = []
    for k in fields:
        here = counted & (F.col("field") == k)
        sums += [F.sum(F.when(here, 1).otherwise(0)).alias(f"__n_{k}"), F.sum(F.when(here, z).otherwise(0)).alias(f"__z_{k}")]
    rare = F.sum(F.when(counted & (F.col("field") == "q") & (z < int(RARE_ZIPF * 1_000_000)), 1).otherwise(0)).alias("__rare")
    got = rows.groupBy(id_col).agg(*[F.first(c).alias(c) for c in plain], *sums, rare)
    for k in fields:
        got = got.withColumn(f"{k}_avg_zipf", _ratio(F.col(f"__z_{k}") / 1_000_000, F.col(f"__n_{k}")))
    return got.withColumn("q_frac_rare", _ratio(F.col("__rare"), F.col("__n_q"))).select(id_col, *FEATURES)
