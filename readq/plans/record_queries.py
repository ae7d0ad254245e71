"""Queries over records: prompts, judges, metrics, embeddings, raw lines, and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readq.functions import nested as N
from readq.functions import numeric as M
from readq.functions import text as T
from readq.operators import annotate as A
from readq.operators import difficulty as D
from readq.operators import embeddings as V
from readq.operators import features as Fe
from readq.operators import metrics as X
from readq.operators import ml
from readq.operators import prep as P
from readq.plans.text_queries import _code, _level, _lix, _words, records
from readq.session import materialise, table

JUDGE = "judge-alder"


def _qg(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qg_dataset")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Documents with two stand-in labels: by id and by length."""
    return table(s, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(3)).cast("bigint").alias("truth"), F.pmod("n_chars", F.lit(3)).cast("bigint").alias("pred"))


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def step_prompts(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d, "passage", "answer", "difficulty").where("passage IS NOT NULL AND answer IS NOT NULL AND difficulty IS NOT NULL")
    p, a, x = F.col("passage"), F.col("answer"), F.col("difficulty")
    return rows.select("rec_id", *[F.md5(P.step_prompt(k, p, x, a)).alias(k) for k in ("step0", "step2", "step3", "step4")])


def t5_inputs(s: SparkSession, d: str) -> DataFrame:
    return P.t5_inputs(_qg(s, d), JUDGE).select("qg_id", "model", F.md5("input_text").alias("input"), "target_text", "difficulty", "lang", "generated")


def triple_texts(s: SparkSession, d: str) -> DataFrame:
    level = F.coalesce("cefr", F.lit("A1"))
    return _qg(s, d).select("qg_id", "annotated_at", N.triple_text("kg_coref", "kg_raw").alias("triples"), N.linearized("kg_raw", level).alias("input"))


def pipeline_drops(s: SparkSession, d: str) -> DataFrame:
    return P.drop_counts(_qg(s, d).withColumn("source", T.code_name("source")), longest=1000)


def reasoning_demand(s: SparkSession, d: str) -> DataFrame:
    rows = _qg(s, d).where("question IS NOT NULL AND answer IS NOT NULL")
    score = D.reasoning_demand("question", "answer", "kg_raw", "kg_coref")
    return rows.select("qg_id", "annotated_at", F.round(score, 6).alias("demand"), T.difficulty_of(F.round(score, 6)).alias("label"))


def judge_scores(s: SparkSession, d: str) -> DataFrame:
    score = P.judge_score("llm_diff_judge", JUDGE)
    return _qg(s, d).select("qg_id", "annotated_at", score.alias("score"), T.difficulty_of(score).alias("label"), N.first_value("llm_diff_judge")["passage_readability"].alias("first"))


def judges_upserted(s: SparkSession, d: str) -> DataFrame:
    new = F.struct(*[F.lit(0.5).alias(c) for c in ("passage_readability", "passage_vocab_diff", "question_cognitive_diff", "question_vocab_diff")])
    m = N.map_upsert("llm_diff_judge", JUDGE, new)
    return _qg(s, d).select("qg_id", "annotated_at", F.size(m).cast("bigint").alias("n"), m[JUDGE]["question_cognitive_diff"].alias("score"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("names"))


def annotation_todo(s: SparkSession, d: str) -> DataFrame:
    return A.todo_groups(_qg(s, d), JUDGE).groupBy(T.code_name("source").alias("source")).agg(F.count("*").alias("n"))


def annotation_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = _qg(s, d).where("passage IS NOT NULL").select("qg_id", "annotated_at", F.md5("passage").alias("p"))
    return A.chunks(rows, ["p"], ["qg_id", "annotated_at"], 3).select("qg_id", "annotated_at", "chunk", "generates")


def cascade_buckets(s: SparkSession, d: str) -> DataFrame:
    return _qg(s, d).groupBy(X.cascade_label().alias("bucket")).agg(F.count("*").alias("n"))


def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    return X.confusion(_pairs(s, d))


def class_report(s: SparkSession, d: str) -> DataFrame:
    return _r(X.class_report(_pairs(s, d)))


def class_weights(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d, "difficulty").select(F.upper(T.code_name("difficulty")).alias("label"))
    return _r(X.class_weights(rows, "label"))


def label_distribution(s: SparkSession, d: str) -> DataFrame:
    return X.label_distribution(_pairs(s, d))


def level_alignment(s: SparkSession, d: str) -> DataFrame:
    return _r(X.alignment(_pairs(s, d), "truth", "pred"))


def rank_correlation(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text IS NOT NULL").select(T.word_count("text").alias("a"), F.length("text").alias("b"))
    return _r(X.spearman(rows, "a", "b"), 4)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(F.lit("EASY"), F.lit("MEDIUM"), F.lit("HARD")), (F.pmod("label", F.lit(3)) + 1).cast("int"))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", names.alias("label"))


def vector_norms(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("id", F.round(M.norm("embedding"), 4).alias("norm"), M.has_nan("embedding").alias("nan"), F.round(M.norm(M.normalised("embedding")), 4).alias("unit"))


def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of every row whose id 50 divides, against all rows."""
    v = _vectors(s, d)
    return V.nearest(v, v.where("id % 50 = 0"), n=5)


def indexed_neighbours(s: SparkSession, d: str) -> DataFrame:
    """The same by an index of cells: nine tenths of the rows of nearest_vectors or more, as measured on other rows."""
    v = _vectors(s, d)
    index = V.VectorIndex(v)
    return index.search(v.where("id % 50 = 0"), n=5, probes=index.probes_for(v, 5, 0.95))


def triplet_losses(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    return V.triplet_losses(V.triplets(v, mode="ordinal"), v)


def spread_penalty(s: SparkSession, d: str) -> DataFrame:
    return V.spread_penalty(_vectors(s, d))


def record_lines(s: SparkSession, d: str) -> DataFrame:
    """The fields of the raw lines that parse, by file."""
    schema = "passage STRING, question STRING, answer STRING, difficulty STRING, source STRING, __broken STRING"
    r = F.from_json("line", schema, {"columnNameOfCorruptRecord": "__broken", "allowSingleQuotes": "false"})
    rows = table(s, d, "qde_lines").withColumn("r", r).where("trim(line) <> '' AND r.__broken IS NULL AND r.passage IS NOT NULL")
    return rows.groupBy("file_name").agg(F.count("*").alias("n"), F.sum(F.length("r.passage")).alias("chars"), F.count_distinct("r.question").alias("questions"))


def verdict_replies(s: SparkSession, d: str) -> DataFrame:
    """Verdicts of the stand-in reader, whose reply is a level word in a sentence."""
    replies = table(s, d, "qde").select("rec_id", F.concat(F.lit("I would say "), F.coalesce("difficulty", F.lit("nothing")), F.lit(".")).alias("reply")).dropDuplicates(["rec_id"])
    return A.verdicts(replies).groupBy("pred").agg(F.count("*").alias("n"))


def feature_probe(s: SparkSession, d: str) -> DataFrame:
    """Boosted trees on the 14 features, fitted on the training split; the report on the test split."""
    rows = records(s, d, "passage", "question", "answer").join(table(s, d, "qde").select("rec_id", "split", T.label_ordinal("difficulty").alias("label")).dropDuplicates(["rec_id"]), "rec_id").where("label IS NOT NULL")
    feats = Fe.feature_table(rows, Fe.word_table(table(s, d, "word_freq"))).join(rows.select("rec_id", "split", F.col("label").cast("double").alias("label")), "rec_id")
    feats = materialise(feats, "features")
    model = ml.boosted_trees(feats.where("split = 'train'"))
    out = model.transform(feats.where("split = 'test'")).select(F.col("label").cast("bigint").alias("truth"), F.col("prediction").cast("bigint").alias("pred"))
    return _r(X.class_report(out))


def vector_probe(s: SparkSession, d: str) -> DataFrame:
    """The linear probe, fitted on four fifths of the rows by a hash of their ids; the report on the rest."""
    rows = table(s, d, "embeddings").select("embedding", F.pmod("label", F.lit(3)).cast("double").alias("label"), M.train_eval_split(F.col("vec_id").cast("string")).alias("part"))
    model = ml.linear_probe(rows.where("part = 'train'"))
    out = model.transform(ml.as_features(rows.where("part = 'eval'")))
    return _r(X.class_report(out.select(F.col("label").cast("bigint").alias("truth"), F.col("prediction").cast("bigint").alias("pred"))))


_dl = "SELECT doc_id, doc_id % 3 AS truth, n_chars % 3 AS pred FROM documents"
_sum = "CASE WHEN {0} < 1/3::DOUBLE THEN 'EASY' WHEN {0} < 2/3::DOUBLE THEN 'MEDIUM' WHEN {0} IS NOT NULL THEN 'HARD' END"
_tri = "array_to_string(list_transform((CASE WHEN len(kg_coref) > 0 THEN kg_coref WHEN len(kg_raw) > 0 THEN kg_raw ELSE [] END)[1:15], lambda t: concat_ws(' | ', t.s, t.r, t.o)), ' ; ')"
_emb = "(SELECT vec_id AS id, embedding, CASE label % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS label FROM embeddings)"
_j = f"map_extract_value(llm_diff_judge, '{JUDGE}')"
_cover = "list_filter(coalesce(kg_raw, []), lambda t: contains(lower(t.s), lower(answer)) OR contains(lower(t.o), lower(answer)))"
_pron = "(" + ",".join(f"'{p}'" for p in D.PRONOUNS) + ")"
_qscore = "CASE " + " ".join(f"WHEN starts_with(lower(trim(question)), '{k}') THEN {v}" for k, v in sorted(T.QTYPE_SCORES.items(), key=lambda x: -len(x[0]))) + " ELSE 0.5 END"
_prompts = {"m1": "'generate question: ' || base", "m2": "'generate question: difficulty: ' || dl || ' ' || base", "m3": "'generate question: ' || base || ' triples: ' || tri", "m4": "'generate question: difficulty: ' || dl || ' ' || base || ' triples: ' || tri", "m5": "'generate question: difficulty: ' || dl || ' ' || base"}

SQL = {
    "step_prompts": """SELECT rec_id, md5('generate question: context: ' || passage) AS step0, md5('generate question: difficulty: ' || difficulty || ' context: ' || passage) AS step2, md5('generate question: focus: ' || answer || ' context: ' || passage) AS step3,
        md5('generate question: difficulty: ' || difficulty || ' focus: ' || answer || ' context: ' || passage) AS step4 FROM (SELECT DISTINCT rec_id, passage, answer, difficulty FROM qde) WHERE passage IS NOT NULL AND answer IS NOT NULL AND difficulty IS NOT NULL""",
    "t5_inputs": f"WITH r AS (SELECT qg_id, question, lang, coalesce(generated, false) AS generated, lower({_sum.format('s')}) AS dl, 'passage: ' || passage || ' answer: ' || answer AS base, tri FROM (SELECT *, {_j}.question_cognitive_diff AS s, {_tri} AS tri FROM qg_dataset) WHERE s IS NOT NULL AND passage IS NOT NULL AND answer IS NOT NULL AND question IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT qg_id, '{m}' AS model, md5({p}) AS input, question AS target_text, dl AS difficulty, lang, generated FROM r" for m, p in _prompts.items()),
    "triple_texts": f"SELECT qg_id, annotated_at, {_tri} AS triples, 'generate question level=' || coalesce(cefr, 'A1') || ': ' || array_to_string(list_transform(kg_raw, lambda t: concat_ws(' | ', t.s, t.r, t.o)), ' . ') AS input FROM qg_dataset",
    "pipeline_drops": f"SELECT source, count(*) AS n_in, count(*) FILTER (l) AS too_long, count(*) FILTER (NOT l AND f) AS too_few, count(*) FILTER (NOT l AND NOT f) AS kept FROM (SELECT {_code.format('source')} AS source, length(passage) > 1000 AS l, coalesce(len(kg_raw) < 2, false) AS f FROM qg_dataset WHERE passage IS NOT NULL) GROUP BY 1",
    "reasoning_demand": f"""WITH c AS (SELECT qg_id, annotated_at, {_qscore}::DOUBLE AS qs, {_cover} AS cov, kg_raw, kg_coref FROM qg_dataset WHERE question IS NOT NULL AND answer IS NOT NULL),
        x AS (SELECT *, CASE WHEN len(coalesce(kg_coref, [])) = 0 OR coalesce(kg_raw, []) = kg_coref OR len(cov) = 0 THEN 0.0 ELSE len(list_filter(cov, lambda t: lower(t.s) IN {_pron} OR lower(t.o) IN {_pron}))::DOUBLE / len(cov) END AS sc FROM c),
        y AS (SELECT qg_id, annotated_at, round(least(1.0, 0.45::DOUBLE * qs + 0.30::DOUBLE * sc + 0.15::DOUBLE * CASE WHEN len(cov) > 0 THEN 0.0 ELSE 1.0 END + 0.10::DOUBLE * least(len(coalesce(kg_raw, [])) / 15.0::DOUBLE, 1.0)), 6) AS demand FROM x) SELECT *, {_sum.format('demand')} AS label FROM y""",
    "judge_scores": f"SELECT qg_id, annotated_at, {_j}.question_cognitive_diff AS score, {_sum.format(_j + '.question_cognitive_diff')} AS label, map_extract_value(llm_diff_judge, list_sort(map_keys(llm_diff_judge))[1]).passage_readability AS first FROM qg_dataset",
    "judges_upserted": f"WITH k AS (SELECT qg_id, annotated_at, list_sort(list_distinct(list_append(coalesce(map_keys(llm_diff_judge), []), '{JUDGE}'))) AS names FROM qg_dataset) SELECT qg_id, annotated_at, len(names) AS n, 0.5::DOUBLE AS score, array_to_string(names, ',') AS names FROM k",
    "annotation_todo": f"WITH r AS (SELECT *, coalesce(list_contains(map_keys(llm_diff_judge), '{JUDGE}'), false) AS has FROM qg_dataset) SELECT {_code.format('source')} AS source, count(*) AS n FROM r WHERE coalesce(passage, '') NOT IN (SELECT coalesce(passage, '') FROM r GROUP BY 1 HAVING bool_and(has)) GROUP BY 1",
    "annotation_chunks": "SELECT qg_id, annotated_at, (k - 1) // 3 AS chunk, (k - 1) // 3 = 0 AS generates FROM (SELECT qg_id, annotated_at, row_number() OVER (PARTITION BY passage ORDER BY qg_id, annotated_at NULLS FIRST) AS k FROM qg_dataset WHERE passage IS NOT NULL)",
    "cascade_buckets": "SELECT CASE WHEN qa_cascade_diff <= 1/3::DOUBLE THEN 'hard' WHEN qa_cascade_diff <= 2/3::DOUBLE THEN 'medium' WHEN qa_cascade_diff IS NOT NULL THEN 'easy' END AS bucket, count(*) AS n FROM qg_dataset GROUP BY 1",
    "confusion_matrix": f"SELECT t.k AS truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2 FROM (SELECT unnest([0, 1, 2]) AS k) t LEFT JOIN ({_dl}) ON truth = t.k GROUP BY 1",
    "class_report": f"""WITH p AS ({_dl}), k AS (SELECT unnest([0, 1, 2]) AS k), s AS (SELECT k, count(*) FILTER (truth = k AND pred = k) AS hit, count(*) FILTER (pred = k) AS said, count(*) FILTER (truth = k) AS support FROM k, (SELECT * FROM p WHERE pred IS NOT NULL) GROUP BY 1),
        r AS (SELECT *, CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS rc FROM s), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM r)
        SELECT k::VARCHAR AS class, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM f
        UNION ALL SELECT 'macro', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
        UNION ALL SELECT 'weighted', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f
        UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f""",
    "class_weights": f"WITH c AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT rec_id, upper({_code.format('difficulty')}) AS label FROM qde) WHERE label IS NOT NULL GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c",
    "label_distribution": f"WITH p AS ({_dl}) SELECT label, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred FROM (SELECT truth AS label, count(*) AS n_true FROM p GROUP BY 1) FULL JOIN (SELECT pred AS label, count(*) AS n_pred FROM p GROUP BY 1) USING (label) WHERE label IS NOT NULL",
    "level_alignment": f"SELECT truth AS level, count(*) AS n, round(avg((pred = truth)::INT), 6) AS aligned FROM ({_dl}) GROUP BY 1",
    "rank_correlation": f"WITH t AS (SELECT len({_words.format('text')}) AS a, length(text) AS b FROM documents WHERE text IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM t) SELECT round(corr(x, y), 4) AS rho, count(*) AS n FROM r",
    "vector_norms": f"SELECT id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, len(list_filter(embedding, lambda x: isnan(x))) > 0 AS nan, 1.0::DOUBLE AS unit FROM {_emb}",
    "nearest_vectors": f"""WITH e AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM {_emb}),
        p AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.id % 50 = 0 AND a.id <> b.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
    "triplet_losses": f"""WITH e AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM {_emb}), a AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) - 1 AS place FROM e), s AS (SELECT label, count(*) AS size FROM a GROUP BY 1),
        o AS (SELECT a.*, list_filter((SELECT list(label ORDER BY label) FROM s), lambda x: x <> a.label) AS others, ('0x' || substr(md5('negative|' || id), 1, 8))::BIGINT AS draw FROM a),
        r AS (SELECT *, CASE WHEN label IN ('EASY', 'HARD') THEN 'MEDIUM' ELSE label END AS pl, CASE label WHEN 'EASY' THEN 'HARD' WHEN 'HARD' THEN 'EASY' ELSE others[draw % len(others) + 1] END AS nl FROM o),
        t AS (SELECT r.id AS anchor, p.id AS positive, n.id AS negative FROM r JOIN s ps ON ps.label = pl JOIN s ns ON ns.label = nl JOIN a p ON p.label = pl AND p.place = (r.place + (pl = r.label)::INT) % ps.size JOIN a n ON n.label = nl AND n.place = r.place % ns.size)
        SELECT anchor, positive, negative, round(greatest(list_cosine_similarity(x.v, z.v) - list_cosine_similarity(x.v, y.v) + 0.5, 0), 6) AS loss FROM t JOIN e x ON x.id = anchor JOIN e y ON y.id = positive JOIN e z ON z.id = negative""",
    "spread_penalty": f"SELECT round(-avg(s), 6) AS penalty FROM (SELECT i, stddev_samp(x) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {_emb}) GROUP BY 1)",
    "verdict_replies": r"SELECT CASE regexp_extract(upper('I would say ' || coalesce(difficulty, 'nothing') || '.'), '\b(EASY|MEDIUM|HARD)\b', 1) WHEN 'EASY' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HARD' THEN 2 ELSE 1 END AS pred, count(*) AS n FROM (SELECT DISTINCT rec_id, difficulty FROM qde) GROUP BY 1",
    "record_lines": "SELECT file_name, count(*) AS n, sum(length(line ->> '$.passage'))::BIGINT AS chars, count(DISTINCT line ->> '$.question') AS questions FROM (SELECT * FROM qde_lines WHERE json_valid(line) AND trim(line) <> '') WHERE line ->> '$.passage' IS NOT NULL GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in (indexed_neighbours, feature_probe, vector_probe)}
del _lix, _level
