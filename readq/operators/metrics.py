"""Classification and agreement metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred_0, pred_1, pred_2): counts, one row for each class, 0 where nothing is."""
    counted = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("truth")).agg(*[F.count(F.when(F.col(pred) == k, 1)).alias(f"pred_{k}") for k in CLASSES])
    every = df.sparkSession.range(len(CLASSES)).withColumnRenamed("id", "truth")
    return every.join(counted, "truth", "left").na.fill(0)


def class_report(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support) of each class, then the rows macro and weighted and accuracy, each from one pass over the data."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(*[F.lit(k) for k in CLASSES])).alias("k"), "t", "p", "n")
    sums = each.groupBy("k").agg(
        F.sum(F.when((F.col("t") == F.col("k")) & (F.col("p") == F.col("k")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("p") == F.col("k"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("t") == F.col("k"), F.col("n")).otherwise(0)).alias("support"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = sums.withColumns({"precision": ratio("hit", "said"), "recall": ratio("hit", "support")})
    total = F.col("precision") + F.col("recall")
    rows = rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
    numbers = ("precision", "recall", "f1")
    classes = rows.select(F.col("k").cast("string").alias("class"), *numbers, F.col("support").cast("bigint").alias("support"))
    n = F.sum("support")
    macro = rows.select(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in numbers], n.cast("bigint").alias("support"))
    weighted = rows.select(F.lit("weighted").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in numbers], n.cast("bigint").alias("support"))
    hits = F.sum("hit") / n
    accuracy = rows.select(F.lit("accuracy").alias("class"), *[hits.alias(c) for c in numbers], n.cast("bigint").alias("support"))
    return classes.union(macro).union(weighted).union(accuracy)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n of all / (number of labels * n of the label)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row for each label
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def label_distribution(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, n_true, n_pred), labels that occur on either side."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n_true"))
    p = df.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("n_pred"))
    return t.join(p, "label", "full_outer").where("label IS NOT NULL").na.fill(0, ["n_true", "n_pred"])


def alignment(df: DataFrame, wanted: str, got: str) -> DataFrame:
    """(level, n, aligned): for each level asked for, the share of rows that reached it."""
    return df.where(F.col(wanted).isNotNull()).groupBy(F.col(wanted).alias("level")).agg(F.count("*").alias("n"), F.avg((F.col(got) == F.col(wanted)).cast("double")).alias("aligned"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the rank of the value, ties at their mean rank. The ranks come from counts per value: the rows themselves are not sorted."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    from readq.operators.ordered import prefix_sum

    ranks = prefix_sum(counts, [F.col(value)], F.col("__n"), "__before").select(value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n): correlation of the average ranks."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(rows, a, "__a"), b, "__b")
    return ranked.agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"))


def cascade_label(score: str = "qa_cascade_diff"):
    """Of three readers' share of right answers: hard up to a third, medium up to two thirds, else easy; the score has four decimals, so
    two of three (0.6667) is easy."""
    c = F.col(score)
    return F.when(c <= 1 / 3, "hard").when(c <= 2 / 3, "medium").when(c.isNotNull(), "easy")


def join_predictions(truth: DataFrame, predicted: DataFrame, key: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """(key, truth, pred) of the items that both tables hold; an item listed again counts with its lowest label."""
    a = truth.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("truth"))
    return a.join(predicted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(pred).alias("pred")), key)
