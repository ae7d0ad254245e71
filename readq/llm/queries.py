"""The queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readq.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
#: So many kinds of container may be wanted.
MAX_KINDS = 1000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.annotator_consensus import Consensus

    labels = Consensus(table(spark, d, "qg_dataset"), min_judges=3).labels()
    return labels.select(F.col("item").alias("qg_id"), "label")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.annotator_consensus import Consensus

    return Consensus(table(spark, d, "qg_dataset")).labels().withColumnRenamed("item", "qg_id")


def p1_judges(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.annotator_consensus import Consensus

    return Consensus(table(spark, d, "qg_dataset")).judges()


def _mix(spark: SparkSession, d: str):
    from readq.llm.source_mixing import SourceMix, record_sizes

    return SourceMix(record_sizes(table(spark, d, "qde")), table(spark, d, "mix_targets"))


def p2_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen().select("mix_id", "source", "difficulty", "rec_id", "repeats")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def _ledger(spark: SparkSession, d: str, batches: int = 3):
    """The lines' keys, and the ledger after the lines were added in batches by the time they were read."""
    from readq.llm.formatting_duplicates import CopyLedger, canonical_lines

    lines = table(spark, d, "qde_lines")
    keys = materialise(canonical_lines(lines.select("line_id", "line")), "keys")
    times = lines.select("line_id", F.col("read_at").cast("timestamp").cast("double").alias("at"))
    ends = times.approxQuantile("at", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    at = sum((F.coalesce(F.col("at") > e, F.lit(True)).cast("int") for e in ends), F.lit(0))
    dated = materialise(keys.join(times.select("line_id", at.alias("batch")), "line_id"), "dated")
    ledger = CopyLedger(spark)
    for k in range(batches):
        ledger.add(dated.where(F.col("batch") == k))
    return keys, ledger


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.formatting_duplicates import duplicate_lines

    return duplicate_lines(*_ledger(spark, d))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record each, as its earliest line has it, with its number of copies."""
    from readq.llm.formatting_duplicates import parsed_lines

    _, ledger = _ledger(spark, d)
    rows = table(spark, d, "qde_lines").select(F.col("line_id").alias("keep_id"), "line").join(ledger.rows().select("keep_id", "copies"), "keep_id")
    return parsed_lines(rows, ["keep_id", "copies"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.linked_splits import linked_groups

    return linked_groups(table(spark, d, "qde").select("rec_id", "passage", "author")).where("rec_id <> group_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.linked_splits import linked_groups, split_groups

    groups = materialise(linked_groups(table(spark, d, "qde").select("rec_id", "passage", "author")), "groups")
    return split_groups(groups, table(spark, d, "split_shares"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.cross_split_overlap import overlapping_records

    pairs = overlapping_records(table(spark, d, "qde"))
    return pairs.where("train_id <> eval_id").select(F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.cross_split_overlap import overlap_report

    return overlap_report(table(spark, d, "qde"))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.response_defects import response_defects, train

    pairs = table(spark, d, "qg_dataset").where("qg_id IS NOT NULL")
    return response_defects(pairs, train(pairs))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect IS NOT NULL").groupBy("qg_id").agg(F.min("defect").alias("defect"))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by defect; null stands for sound ones."""
    return _defects(spark, d).distinct().groupBy("defect").agg(F.count("*").alias("pairs"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.reading_level import reading_levels, train

    model = train(table(spark, d, "graded_passages"))
    return reading_levels(table(spark, d, "qde").select("rec_id", "passage").where("rec_id IS NOT NULL"), model)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).groupBy("rec_id").agg(F.min("level").alias("level"))


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """How demanding the corpus is: records, mean and median difficulty of each level."""
    each = _levels(spark, d).groupBy("rec_id").agg(F.min("level").alias("level"), F.min("difficulty").alias("difficulty"))
    return each.groupBy("level").agg(F.count("*").alias("records"), F.avg("difficulty").alias("mean_difficulty"), F.percentile_approx("difficulty", 0.5).alias("median_difficulty"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.bpe_encoding import encode_texts

    return encode_texts(table(spark, d, "documents"))


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text or piece, for each kind of container."""
    from functools import reduce

    from readq.llm.bpe_encoding import count_tokens, vocabulary
    from readq.llm.container_packing import pack

    kinds = table(spark, d, "bin_sizes").where("bin_kind IS NOT NULL AND tokenizer IS NOT NULL AND capacity > 0").orderBy("bin_kind").limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    documents = table(spark, d, "documents")
    sizes = {name: materialise(count_tokens(documents, path=vocabulary(name)), "sizes") for name in {k["tokenizer"] for k in kinds}}
    parts = [pack(sizes[k["tokenizer"]], k["capacity"]).select(F.lit(k["bin_kind"]).alias("bin_kind"), "doc_id", "piece", "size", "container") for k in kinds]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "bin_kind STRING, doc_id BIGINT, piece INT, size INT, container BIGINT")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of container: their number, the least number that could hold all tokens, and the room used."""
    sizes = table(spark, d, "bin_sizes").groupBy("bin_kind").agg(F.max("capacity").alias("capacity"))
    used = p9_bins(spark, d).groupBy("bin_kind", "container").agg(F.sum("size").alias("size"))
    kinds = used.groupBy("bin_kind").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers")
    return kinds.join(sizes, "bin_kind").select("bin_kind", "capacity", "containers", least, "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"))


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.language_id import fit_filter, language_stretches

    documents = table(spark, d, "documents")
    labelled = documents.select("text", "lang").union(table(spark, d, "qg_dataset").select("passage", "lang"))
    return language_stretches(documents, fit_filter(labelled))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from readq.llm.language_id import label_cases

    return label_cases(_stretches(spark, d)).select("doc_id", "seg_no", "lang")


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d)


ALL = (
    p1_found, p1_consensus, p1_judges, p2_mix, p2_shares, p3_found, p3_report, p4_found, p4_records, p5_found, p5_splits,
    p6_found, p6_profile, p7_found, p7_profile, p8_ids, p9_bins, p9_fill, p10_found, p10_stretches,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


_code = "nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_canon = r"regexp_replace(lower({0}), '[\p{{P}}\p{{Z}}\p{{C}}\s\x{{34F}}\x{{115F}}\x{{1160}}\x{{17B4}}\x{{17B5}}\x{{180B}}-\x{{180F}}\x{{3164}}\x{{FE00}}-\x{{FE0F}}\x{{FFA0}}]+', '', 'g')"
_fields = ("passage", "question", "answer", "difficulty", "source")
_sound = (
    "SELECT line_id, " + ", ".join(f"line ->> '$.{f}' AS {f}" for f in _fields) + ", md5(" + " || chr(31) || ".join(f"coalesce({_canon.format(f"(line ->> '$.{f}')")}, '')" for f in _fields) + ") AS key "
    "FROM (SELECT * FROM qde_lines WHERE json_valid(line)) WHERE json_type(line) = 'OBJECT' AND list_has_all(json_keys(line), [" + ", ".join(f"'{f}'" for f in _fields) + "])"
)
# Mixing: sizes of the ingredients, water-filling in order of cap / weight, then the records in the seeded order within the rest.
_mixing = f"""
r AS (SELECT rec_id, min({_code.format('source')}) AS source, min(upper({_code.format('difficulty')})) AS difficulty, max(coalesce(length(passage), 0) + coalesce(length(question), 0) + coalesce(length(answer), 0)) AS size FROM qde WHERE rec_id IS NOT NULL GROUP BY 1),
i0 AS (SELECT mix_id, {_code.format('source')} AS source, upper({_code.format('difficulty')}) AS difficulty, sum(weight) AS weight, max(max_repeats) AS max_repeats, max(size_ratio) AS size_ratio FROM mix_targets WHERE weight > 0 AND max_repeats > 0 AND mix_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT i0.mix_id, i0.source, i0.difficulty, r.rec_id, r.size FROM i0 JOIN r ON r.source = i0.source AND (r.difficulty = i0.difficulty OR (i0.difficulty IS NULL AND NOT EXISTS (SELECT 1 FROM i0 x WHERE x.mix_id = i0.mix_id AND x.source = i0.source AND x.difficulty = r.difficulty)))),
i1 AS (SELECT i0.*, coalesce(n.n, 0) AS records, coalesce(n.size, 0) AS size, coalesce(n.size, 0) * max_repeats AS cap, max(size_ratio) OVER (PARTITION BY i0.mix_id) * (SELECT sum(size) FROM r) AS wanted FROM i0 LEFT JOIN (SELECT mix_id, source, difficulty, count(*) AS n, sum(size) AS size FROM m GROUP BY 1, 2, 3) n ON n.mix_id = i0.mix_id AND n.source = i0.source AND n.difficulty IS NOT DISTINCT FROM i0.difficulty),
i2 AS (SELECT *, (wanted - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM i1 WINDOW w AS (PARTITION BY mix_id ORDER BY cap / weight, source, difficulty NULLS FIRST)),
i3 AS (SELECT *, cap <= level * weight AS clamped, max(CASE WHEN cap > level * weight THEN level END) OVER (PARTITION BY mix_id) AS final, weight / sum(weight) OVER (PARTITION BY mix_id) AS target_share FROM i2),
i4 AS (SELECT *, CASE WHEN size > 0 THEN least(round((CASE WHEN clamped THEN cap ELSE final * weight END) / size, 9), max_repeats) ELSE 0 END AS epochs FROM i3),
i5 AS (SELECT *, floor(epochs) AS whole, round((epochs - floor(epochs)) * size, 3) AS rest FROM i4),
c AS (SELECT m.*, whole, rest, sum(m.size) OVER (PARTITION BY m.mix_id, m.source, m.difficulty ORDER BY md5('20|' || m.mix_id || '|' || m.rec_id::VARCHAR), m.rec_id) AS upto FROM m JOIN i5 ON i5.mix_id = m.mix_id AND i5.source = m.source AND i5.difficulty IS NOT DISTINCT FROM m.difficulty),
g AS (SELECT mix_id, source, difficulty, rec_id, size, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INT AS repeats FROM c)"""

SQL = {
    "p2_mix": f"WITH {_mixing} SELECT mix_id, source, difficulty, rec_id, repeats FROM g WHERE repeats > 0",
    "p2_shares": f"""WITH {_mixing}, s AS (SELECT mix_id, source, difficulty, count(*) AS n, sum(size * repeats) AS reached FROM g WHERE repeats > 0 GROUP BY 1, 2, 3)
        SELECT i5.mix_id, i5.source, i5.difficulty, round(target_share, 6) AS target_share, coalesce(n, 0) AS n_records, coalesce(reached, 0)::BIGINT AS reached_size, round(wanted, 1) AS wanted_size,
          round(coalesce(reached / sum(reached) OVER (PARTITION BY i5.mix_id), 0.0), 6) AS reached_share FROM i5 LEFT JOIN s ON s.mix_id = i5.mix_id AND s.source = i5.source AND s.difficulty IS NOT DISTINCT FROM i5.difficulty""",
    "p4_found": f"WITH s AS ({_sound}), k AS (SELECT line_id, min(line_id) OVER (PARTITION BY key) AS keep_id FROM s) SELECT keep_id, line_id AS dup_id FROM k WHERE keep_id <> line_id",
    "p4_records": f"WITH s AS ({_sound}), k AS (SELECT *, min(line_id) OVER (PARTITION BY key) AS keep_id, count(*) OVER (PARTITION BY key) AS copies FROM s) SELECT keep_id, {', '.join(_fields)}, copies FROM k WHERE keep_id = line_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
