"""Mixing sources to target weights (problem 2).

The sizes of the ingredients decide everything: capped water-filling gives each ingredient its share of the mix, clamped at
its size times the allowed repeats; what a clamped ingredient cannot take goes to the others in proportion to their
weights, until nothing more is clamped. An ingredient that needs e epochs gets every record floor(e) times and, for the
rest, the records that come first in a seeded order, as long as their total stays within the rest. Only the numbers per
ingredient and per slice of that order are aggregated; records are never gathered in one task.

Defined results: rows with a null id are left out; a repeated id counts once; null texts have size 0. Ingredients listed
twice are added together. An ingredient without difficulty takes the difficulties that no other ingredient of the same mix
and source names, so no record is in two ingredients of a mix. Null or non-positive weights and repeats take nothing. If all
ingredients are clamped, the mix stays smaller than wanted. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readq.functions.text import code_name
from readq.session import materialise

#: Tables of ingredients up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 10_000


def record_sizes(df: DataFrame, text_cols: tuple[str, ...] = ("passage", "question", "answer")) -> DataFrame:
    """(rec_id, source, difficulty, size): one row for each id, with plain codes and the number of characters of the texts."""
    size = sum((F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in text_cols), F.lit(0).cast("bigint"))
    rows = df.where("rec_id IS NOT NULL").select(F.col("rec_id").cast("bigint").alias("rec_id"), code_name("source").alias("source"), F.upper(code_name("difficulty")).alias("difficulty"), size.alias("size"))
    return rows.groupBy("rec_id").agg(F.min("source").alias("source"), F.min("difficulty").alias("difficulty"), F.max("size").alias("size"))


def water_fill(sizes: DataFrame) -> DataFrame:
    """Add `amount`, the size each ingredient contributes. Input: mix_id, weight, cap (the most it can give), wanted (size of the mix).

    In order of cap / weight, an ingredient is clamped while its cap is below its proportional part of what the clamped
    ones before it leave over; from the first that isn't, all get the same level times their weight.
    """
    order = Window.partitionBy("mix_id").orderBy(F.col("cap") / F.col("weight"), "source", F.col("difficulty").asc_nulls_first())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    leveled = sizes.withColumns({"level": level, "place": F.row_number().over(order)}).withColumn("clamped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("clamped"), F.struct("place", "level"))).over(Window.partitionBy("mix_id"))
    return leveled.withColumn("amount", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(final["level"] * F.col("weight"))).drop("level", "place", "clamped")


class SourceMix:
    """The chosen records and the reached shares of every mix of a table of targets."""

    def __init__(self, records: DataFrame, targets: DataFrame, seed: int = 20, slices: int = 4096):
        """records: as record_sizes gives them. slices: into how many slices the seeded order of an ingredient is cut; a
        slice is what one task sorts, so it grows with the data."""
        self.seed, self.slices = seed, slices
        self.records = materialise(records, "sizes")
        usable = targets.where("weight > 0 AND max_repeats > 0 AND mix_id IS NOT NULL AND source IS NOT NULL")
        listed = usable.groupBy("mix_id", code_name("source").alias("source"), F.upper(code_name("difficulty")).alias("difficulty")).agg(
            F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio")
        )
        others = F.collect_set("difficulty").over(Window.partitionBy("mix_id", "source"))
        listed = listed.withColumn("named", others)
        self.listed = F.broadcast(listed) if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else listed

    def _matched(self, ingredients: DataFrame) -> DataFrame:
        i, r = ingredients.alias("i"), self.records.alias("r")
        other = F.col("i.difficulty").isNull() & ~F.coalesce(F.array_contains("i.named", F.col("r.difficulty")), F.lit(False))
        return r.join(i, (F.col("r.source") == F.col("i.source")) & (other | (F.col("i.difficulty") == F.col("r.difficulty"))))

    def ingredients(self) -> DataFrame:
        """One row for each ingredient: its records, their size, and the amount and epochs it gets."""
        total = self.records.agg(F.sum("size")).first()[0] or 0
        sizes = self._matched(self.listed).groupBy("i.mix_id", "i.source", "i.difficulty").agg(F.count("*").alias("records"), F.sum("r.size").alias("size"))
        keys = ["mix_id", "source", "difficulty"]
        i, s = self.listed.alias("i"), sizes.alias("s")
        on = (F.col("i.mix_id") == F.col("s.mix_id")) & (F.col("i.source") == F.col("s.source")) & F.col("i.difficulty").eqNullSafe(F.col("s.difficulty"))
        have = i.join(s, on, "left").select(*[f"i.{k}" for k in keys], "i.weight", "i.max_repeats", "i.size_ratio", "i.named", F.coalesce("s.records", F.lit(0)).alias("records"), F.coalesce("s.size", F.lit(0)).alias("size"))
        mix = Window.partitionBy("mix_id")
        have = have.withColumn("all_size", F.lit(total).cast("bigint"))
        have = have.withColumn("cap", F.col("size") * F.col("max_repeats")).withColumn("wanted", F.max("size_ratio").over(mix) * F.col("all_size"))
        filled = water_fill(have).withColumn("target_share", F.col("weight") / F.sum("weight").over(mix))
        # Rounded, so that the last bits of the arithmetic never decide about an epoch or a record.
        epochs = F.when(F.col("size") > 0, F.round(F.col("amount") / F.col("size"), 9)).otherwise(F.lit(0.0))
        filled = filled.withColumn("epochs", F.least(epochs, F.col("max_repeats").cast("double"))).withColumn("whole", F.floor("epochs"))
        return filled.withColumn("rest", F.round((F.col("epochs") - F.col("whole")) * F.col("size"), 3))

    def chosen(self) -> DataFrame:
        """(mix_id, source, difficulty, rec_id, size, repeats) of each record that is in a mix; the difficulty is the ingredient's."""
        plan = materialise(self.ingredients(), "plan")
        plan = F.broadcast(plan) if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plan
        draw = F.md5(F.concat_ws("|", F.lit(str(self.seed)), "i.mix_id", F.col("r.rec_id").cast("string")))
        rows = self._matched(plan).select("i.mix_id", "i.source", "i.difficulty", "i.whole", "i.rest", "r.rec_id", "r.size", draw.alias("draw"))
        rows = rows.withColumn("slice", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint") * self.slices / F.lit(2**32), F.lit(self.slices)).cast("int"))
        keys = ["mix_id", "source", "difficulty"]
        # The slices of an ingredient, in order: the rest ends inside one of them, and only that one is sorted.
        per = rows.where("rest > 0").groupBy(*keys, "slice").agg(F.sum("size").alias("in_slice"), F.max("rest").alias("top"))
        ahead = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("start", F.coalesce(F.sum("in_slice").over(ahead), F.lit(0)))
        cut = per.where("start + in_slice > top").groupBy(*keys).agg(F.min(F.struct("slice", "start")).alias("cut"))
        r, c = rows.alias("r"), cut.alias("c")
        on = (F.col("r.mix_id") == F.col("c.mix_id")) & (F.col("r.source") == F.col("c.source")) & F.col("r.difficulty").eqNullSafe(F.col("c.difficulty"))
        small = self.listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = r.join(F.broadcast(c) if small else c, on, "left").select("r.*", "c.cut")
        # Rows outside the slice in which the rest ends are told by their slice alone, in one pass.
        plain = rows.where("rest <= 0 OR cut IS NULL OR slice <> cut.slice").withColumn("extra", F.when(F.expr("rest > 0 AND (cut IS NULL OR slice < cut.slice)"), 1).otherwise(0))
        inside = Window.partitionBy(*keys).orderBy("draw", "rec_id").rowsBetween(Window.unboundedPreceding, 0)
        edge = rows.where("rest > 0 AND slice = cut.slice").withColumn("extra", F.when(F.col("cut.start") + F.sum("size").over(inside) <= F.col("rest"), 1).otherwise(0))
        every = plain.unionByName(edge)
        return every.withColumn("repeats", (F.col("whole") + F.col("extra")).cast("int")).where("repeats > 0").select(*keys, "rec_id", "size", "repeats")

    def shares(self) -> DataFrame:
        """Target and reached share of each ingredient, with its records and its size in the mix."""
        keys = ["mix_id", "source", "difficulty"]
        got = self.chosen().groupBy(*keys).agg(F.count("*").alias("n_records"), F.sum(F.col("size") * F.col("repeats")).alias("reached_size"))
        i, g = self.ingredients().alias("i"), got.alias("g")
        on = (F.col("i.mix_id") == F.col("g.mix_id")) & (F.col("i.source") == F.col("g.source")) & F.col("i.difficulty").eqNullSafe(F.col("g.difficulty"))
        rows = i.join(g, on, "left").select(*[f"i.{k}" for k in keys], F.round("i.target_share", 6).alias("target_share"), F.coalesce("g.n_records", F.lit(0)).alias("n_records"), F.coalesce("g.reached_size", F.lit(0)).alias("reached_size"), F.round("i.wanted", 1).alias("wanted_size"))
        return rows.withColumn("reached_share", F.round(F.coalesce(F.col("reached_size") / F.sum("reached_size").over(Window.partitionBy("mix_id")), F.lit(0.0)), 6))
