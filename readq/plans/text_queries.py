"""Queries over texts: words, sentences, question kinds, features, splits and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readq.functions import numeric as M
from readq.functions import text as T
from readq.operators import difficulty as D
from readq.operators import eda as E
from readq.operators import features as Fe
from readq.operators import prep as P
from readq.session import table

_q = "'" + "','".join(T.STOPWORDS) + "'"


def records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The records of qde, each id once as first delivered, with only the columns asked for."""
    rows = table(spark, d, "qde").select("rec_id", *cols, F.col("loaded_at").alias("__at"))
    return P.keep_first(rows, ["rec_id"], ["__at", *cols]).drop("__at")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def split_bucket_counts(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).where("text IS NOT NULL").select(M.hash_split("text").alias("split"), T.word_count("text").alias("w"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


def split_80_20(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("text IS NOT NULL").groupBy(M.train_eval_split("text").alias("split")).agg(F.count("*").alias("n"))


def md5_buckets(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("text IS NOT NULL").select("doc_id", M.md5_mod("text", 100).alias("b100"), M.md5_mod("text", 10).alias("b10"))


def text_counts(s: SparkSession, d: str) -> DataFrame:
    toks = T.tokens("text")
    return documents(s, d).where("text IS NOT NULL").select(
        "doc_id", T.word_count("text").alias("n_words"), T.sentence_count("text").alias("n_sents"), T.sentence_count_by_marks("text").alias("n_parts"), T.end_mark_runs("text").alias("n_marks"),
        F.size(toks).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("bigint").alias("n_types"), F.size(T.content_words(toks)).cast("bigint").alias("n_content"),
    )


def question_kinds(s: SparkSession, d: str) -> DataFrame:
    return records(s, d, "question").where("question IS NOT NULL").groupBy(T.question_kind("question").alias("kind")).agg(F.count("*").alias("n"))


def question_scores(s: SparkSession, d: str) -> DataFrame:
    return records(s, d, "question").where("question IS NOT NULL").select("rec_id", T.wh_ordinal("question").alias("wh"), T.qtype_score("question").alias("score"), T.first_year("question").cast("bigint").alias("year"))


def feature_table(s: SparkSession, d: str) -> DataFrame:
    return Fe.feature_table(records(s, d, "passage", "question", "answer"), Fe.word_table(table(s, d, "word_freq")))


def zipf_table(s: SparkSession, d: str) -> DataFrame:
    return Fe.word_table(table(s, d, "word_freq")).select("word", F.round("zipf", 6).alias("zipf"))


def frequency_bands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "word_freq").groupBy(M.frequency_band("freq").alias("band")).agg(F.count("*").alias("n"))


def lix_levels(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("text IS NOT NULL").select("doc_id", F.round(T.lix("text"), 6).alias("lix"), D.passage_level("text").alias("level"))


def level_distribution(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("text IS NOT NULL").groupBy(D.passage_level("text").alias("level")).agg(F.count("*").alias("n"))


def eda_percentiles(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(T.code_name("source").alias("source"), "text")
    got = E.describe(rows, "source", T.word_count("text"))
    return got.select("source", "count", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p25", "p50", "p75", "p95")])


def eda_nearest_rank(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(T.code_name("source").alias("source"), "text")
    return E.nearest_rank(rows, "source", F.length("text").cast("bigint"))


def top_answers(s: SparkSession, d: str) -> DataFrame:
    return E.top_values(records(s, d, "answer"), T.collapse("answer"), 8)


def group_size_stats(s: SparkSession, d: str) -> DataFrame:
    got = E.group_sizes(records(s, d, "passage"), "passage", "rec_id")
    return got.select("groups", "members", "singles", "largest", F.round("mean_size", 6).alias("mean_size"))


def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "qde").select(F.md5("passage").alias("p"), F.md5(F.concat_ws("||", F.substring("passage", 1, 80), "question")).alias("pq"))
    return rows.agg(F.count_distinct("p").alias("passages"), F.count_distinct("pq").alias("pairs"))


def source_counts(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d, "source", "split", "difficulty").select(T.code_name("source").alias("source"), "split", F.upper(T.code_name("difficulty")).alias("difficulty"))
    return rows.groupBy("source", "split").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("difficulty") == x, 1)).alias(x.lower()) for x in ("EASY", "MEDIUM", "HARD")])


def balanced_cap(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d, "difficulty").select("rec_id", F.upper(T.code_name("difficulty")).alias("difficulty")).where("difficulty IS NOT NULL")
    return P.first_per_group(rows, ["difficulty"], ["rec_id"], 100)


def first_of_passage(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "qde").where("passage IS NOT NULL AND question IS NOT NULL").select("rec_id", F.md5(F.concat(F.substring("passage", 1, 80), F.lit("||"), "question")).alias("key"))
    return P.keep_first(rows, ["key"], ["rec_id"])


def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return P.seeded_sample(table(s, d, "qde").select("rec_id").distinct(), "rec_id", 200)


def answer_in_passage(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d, "passage", "answer", "source").where("passage IS NOT NULL AND answer IS NOT NULL")
    hit = T.contains_text("passage", "answer").cast("bigint")
    return rows.groupBy(T.code_name("source").alias("source")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))


def answer_f1(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "qg_dataset").where("question IS NOT NULL AND answer IS NOT NULL AND lower(trim(lang)) = 'en'").select("qg_id", "question", "answer").dropDuplicates(["qg_id"])
    return rows.select("qg_id", F.round(M.token_f1(T.plain_tokens("question"), T.plain_tokens("answer")), 6).alias("f1"))


def truncated(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("text IS NOT NULL").select("doc_id", F.md5(T.truncate_words("text", 40)).alias("start"))


def parsed_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qde").groupBy(T.parsed_label("difficulty").alias("label")).agg(F.count("*").alias("n"))


# ---- the same in SQL ----

_words = r"list_filter(regexp_split_to_array({0}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0B}}]+'), lambda w: w <> '')"
_marks = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', '', 'g')"
_code = "nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_mod = "((((('0x' || substr(md5({0}), 1, 8))::BIGINT % {1} * {2} + ('0x' || substr(md5({0}), 9, 8))::BIGINT) % {1} * {2} + ('0x' || substr(md5({0}), 17, 8))::BIGINT) % {1} * {2} + ('0x' || substr(md5({0}), 25, 8))::BIGINT) % {1})"
_toks = "regexp_extract_all(lower({0}), '[a-z'']+')"
_trim = "trim({0})"
_sents = r"len(string_split(regexp_replace(trim({0}), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)))"
_parts = r"greatest(1, len(list_filter(regexp_split_to_array({0}, '[.!?]+'), lambda s: trim(s) <> '')))"
_zipf = "SELECT lower(trim(word)) AS word, max(coalesce(zipf, CASE WHEN freq > 0 THEN log10(freq) + 9 END, 0.0)) AS zipf FROM word_freq WHERE word IS NOT NULL GROUP BY 1"
_lix = (
    r"WITH w AS (SELECT doc_id, text, " + _words.format("text") + r" AS words, len(list_filter(string_split(text, '.'), lambda s: trim(s) <> '')) AS sents FROM documents WHERE text IS NOT NULL), "
    r"l AS (SELECT doc_id, CASE WHEN len(words) = 0 OR sents = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (len(words)::DOUBLE / sents + len(list_filter(words, lambda x: length(regexp_replace(x, '[.,!?;:]+$', '')) > 6)) * 100.0::DOUBLE / len(words) - 20.0) / 45.0)) END AS lix FROM w)"
)
_level = "CASE WHEN {0} >= 6.5/7::DOUBLE THEN 'C2+' WHEN {0} >= 5.5/7::DOUBLE THEN 'C2' WHEN {0} >= 4.5/7::DOUBLE THEN 'C1' WHEN {0} >= 3.5/7::DOUBLE THEN 'B2' WHEN {0} >= 2.5/7::DOUBLE THEN 'B1' WHEN {0} >= 1.5/7::DOUBLE THEN 'A2' WHEN {0} >= 0.5/7::DOUBLE THEN 'A1' ELSE 'preA1' END"
_kind = "CASE " + " ".join(f"WHEN starts_with(lower(trim(question)), '{k}') THEN '{k}'" for k in T.QUESTION_KINDS) + rf" WHEN regexp_matches(lower(trim(question)), '^({T.AUXILIARIES})\b') THEN 'yes/no' ELSE 'other' END"
_score = "CASE " + " ".join(f"WHEN starts_with(lower(trim(question)), '{k}') THEN {v}" for k, v in sorted(T.QTYPE_SCORES.items(), key=lambda x: -len(x[0]))) + " ELSE 0.5 END"
_wh = "CASE " + " ".join(f"WHEN ({_words.format('lower(question)')})[1] = '{w}' THEN {i}" for i, w in enumerate(T.WH_WORDS)) + " ELSE 9 END"


def _zipf_of(short: str, col: str) -> str:
    return f"""{short}z AS (SELECT rec_id, count(*) AS n, sum(coalesce(zipf, 0.0)::DECIMAL(12, 6))::DOUBLE AS s, count(*) FILTER (coalesce(zipf, 0.0) < 3.0) AS r
        FROM (SELECT rec_id, unnest({_toks.format(f"coalesce({col}, '')")}) AS word FROM q) t LEFT JOIN z USING (word) WHERE NOT contains(word, '''') GROUP BY 1)"""


_features = f"""
WITH q AS (SELECT DISTINCT rec_id, coalesce(passage, '') AS passage, coalesce(question, '') AS question, coalesce(answer, '') AS answer FROM qde),
z AS ({_zipf}), {_zipf_of("q", "question")}, {_zipf_of("p", "passage")}, {_zipf_of("a", "answer")},
t AS (SELECT *, {_toks.format("question")} AS qt, {_toks.format("passage")} AS pt, {_toks.format("answer")} AS aw, {_parts.format("passage")} AS ps FROM q),
c AS (SELECT *, list_filter(qt, lambda x: length(x) > 1 AND x NOT IN ({_q})) AS qc FROM t)
SELECT rec_id, len(qt) AS q_n_tokens, CASE WHEN len(qt) > 0 THEN length(array_to_string(qt, ''))::DOUBLE / len(qt) ELSE 0 END AS q_avg_wlen, {_wh} AS q_wh_type,
  coalesce(qz.s / qz.n, 0) AS q_avg_zipf, coalesce(qz.r::DOUBLE / qz.n, 0) AS q_frac_rare, len(pt) AS p_n_tokens, ps AS p_n_sents, len(pt)::DOUBLE / ps AS p_avg_slen,
  CASE WHEN len(pt) > 0 THEN len(list_distinct(pt))::DOUBLE / len(pt) ELSE 0 END AS p_ttr, coalesce(pz.s / pz.n, 0) AS p_avg_zipf, len(aw) AS a_n_tokens, coalesce(az.s / az.n, 0) AS a_avg_zipf,
  CASE WHEN len(qc) > 0 THEN len(list_filter(qc, lambda x: list_contains(pt, x)))::DOUBLE / len(qc) ELSE 0 END AS q_p_overlap, contains(lower(passage), lower(answer))::INT::DOUBLE AS a_in_passage
FROM c LEFT JOIN qz USING (rec_id) LEFT JOIN pz USING (rec_id) LEFT JOIN az USING (rec_id)"""

SQL = {
    "split_bucket_counts": f"SELECT CASE WHEN b < 0.8::DOUBLE * 100 THEN 'train' WHEN b < (0.8::DOUBLE + 0.1::DOUBLE) * 100 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(w)::BIGINT AS words FROM (SELECT {_mod.format('text', 100, 96)} AS b, len({_words.format('text')}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "split_80_20": f"SELECT CASE WHEN {_mod.format('text', 10, 6)} < 8 THEN 'train' ELSE 'eval' END AS split, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "md5_buckets": f"SELECT doc_id, {_mod.format('text', 100, 96)} AS b100, {_mod.format('text', 10, 6)} AS b10 FROM documents WHERE text IS NOT NULL",
    "text_counts": f"""SELECT doc_id, len({_words.format('text')}) AS n_words, greatest(1, {_sents.format('text')}) AS n_sents, {_parts.format('text')} AS n_parts, len(regexp_extract_all(text, '[.!?]+')) AS n_marks,
        len(tk) AS n_tokens, len(list_distinct(tk)) AS n_types, len(list_filter(tk, lambda x: length(x) > 1 AND x NOT IN ({_q}))) AS n_content FROM (SELECT *, {_toks.format('text')} AS tk FROM documents WHERE text IS NOT NULL)""",
    "question_kinds": f"SELECT {_kind} AS kind, count(*) AS n FROM (SELECT DISTINCT rec_id, question FROM qde) WHERE question IS NOT NULL GROUP BY 1",
    "question_scores": rf"SELECT rec_id, {_wh} AS wh, {_score}::DOUBLE AS score, try_cast(nullif(regexp_extract(question, '\b(1[0-9]{{3}}|20[0-9]{{2}})\b', 1), '') AS BIGINT) AS year FROM (SELECT DISTINCT rec_id, question FROM qde) WHERE question IS NOT NULL",
    "feature_table": _features,
    "zipf_table": f"SELECT word, round(zipf, 6) AS zipf FROM ({_zipf})",
    "frequency_bands": "SELECT CASE WHEN freq > 0 THEN CASE WHEN freq >= 0.001 THEN 'A1' WHEN freq >= 0.0003 THEN 'A2' WHEN freq >= 0.0001 THEN 'B1' WHEN freq >= 0.00003 THEN 'B2' WHEN freq >= 0.000008 THEN 'C1' ELSE 'C2' END END AS band, count(*) AS n FROM word_freq GROUP BY 1",
    "lix_levels": f"{_lix} SELECT doc_id, round(lix, 6) AS lix, {_level.format('((0.4 + lix) / 4)')} AS level FROM l",
    "level_distribution": f"{_lix} SELECT {_level.format('((0.4 + lix) / 4)')} AS level, count(*) AS n FROM l GROUP BY 1",
    "eda_percentiles": f"SELECT {_code.format('source')} AS source, count(*) AS count, round(avg(w), 6) AS mean, " + ", ".join(f"round(quantile_cont(w, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + f" FROM (SELECT source, len({_words.format('text')})::DOUBLE AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "eda_nearest_rank": f"SELECT source, len(v) AS count, v[1] AS min, v[least(floor(len(v) * 75 / 100)::BIGINT, len(v) - 1) + 1] AS p75, v[least(floor(len(v) * 90 / 100)::BIGINT, len(v) - 1) + 1] AS p90, v[-1] AS max FROM (SELECT {_code.format('source')} AS source, list_sort(list(length(text))) AS v FROM documents WHERE text IS NOT NULL GROUP BY 1)",
    "top_answers": f"SELECT array_to_string({_words.format('answer')}, ' ') AS value, count(*) AS n FROM (SELECT DISTINCT rec_id, answer FROM qde) WHERE answer IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 8",
    "group_size_stats": "SELECT count(*) AS groups, sum(n)::BIGINT AS members, count(*) FILTER (n = 1) AS singles, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT count(DISTINCT rec_id) AS n FROM qde WHERE passage IS NOT NULL GROUP BY passage)",
    "distinct_counts": "SELECT count(DISTINCT passage) AS passages, count(DISTINCT concat_ws('||', substr(passage, 1, 80), question)) AS pairs FROM qde",
    "source_counts": f"SELECT {_code.format('source')} AS source, split, count(*) AS n, count(*) FILTER (d = 'EASY') AS easy, count(*) FILTER (d = 'MEDIUM') AS medium, count(*) FILTER (d = 'HARD') AS hard FROM (SELECT DISTINCT rec_id, source, split, upper({_code.format('difficulty')}) AS d FROM qde) GROUP BY 1, 2",
    "balanced_cap": f"SELECT rec_id, difficulty FROM (SELECT rec_id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY rec_id) AS k FROM (SELECT DISTINCT rec_id, upper({_code.format('difficulty')}) AS difficulty FROM qde) WHERE difficulty IS NOT NULL) WHERE k <= 100",
    "first_of_passage": "SELECT md5(substr(passage, 1, 80) || '||' || question) AS key, min(rec_id) AS rec_id FROM qde WHERE passage IS NOT NULL AND question IS NOT NULL GROUP BY 1",
    "seeded_sample": "SELECT rec_id FROM (SELECT DISTINCT rec_id FROM qde) ORDER BY md5('42|' || rec_id::VARCHAR), rec_id LIMIT 200",
    "answer_in_passage": f"SELECT {_code.format('source')} AS source, count(*) AS n, count(*) FILTER (contains(lower(passage), lower(answer))) AS hits FROM (SELECT DISTINCT rec_id, passage, answer, source FROM qde) WHERE passage IS NOT NULL AND answer IS NOT NULL GROUP BY 1",
    "answer_f1": f"""WITH t AS (SELECT qg_id, {_words.format("x")} AS a, {_words.format("y")} AS b FROM (SELECT DISTINCT qg_id, {_marks.format("question")} AS x, {_marks.format("answer")} AS y FROM qg_dataset WHERE question IS NOT NULL AND answer IS NOT NULL AND lower(trim(lang)) = 'en'))
        SELECT qg_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 OR c = 0 THEN 0.0 ELSE 2.0 * (c::DOUBLE / len(a)) * (c::DOUBLE / len(b)) / (c::DOUBLE / len(a) + c::DOUBLE / len(b)) END, 6) AS f1 FROM (SELECT *, len(list_distinct(list_intersect(a, b))) AS c FROM t)""",
    "truncated": f"SELECT doc_id, md5(CASE WHEN len(w) > 40 THEN array_to_string(w[1:40], ' ') ELSE text END) AS start FROM (SELECT doc_id, text, {_words.format('text')} AS w FROM documents WHERE text IS NOT NULL)",
    "parsed_labels": r"SELECT CASE regexp_extract(upper(difficulty), '\b(EASY|MEDIUM|HARD)\b', 1) WHEN 'EASY' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HARD' THEN 2 ELSE 1 END AS label, count(*) AS n FROM qde GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
