"""The ten operators on small hand-made tables: right results, and nulls, empty and long texts, ties, repeated rows, empty tables and
further columns with clashing names."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readq.llm import annotator_consensus as AC
from readq.llm import bpe_encoding as BE
from readq.llm import container_packing as CP
from readq.llm import cross_split_overlap as CO
from readq.llm import formatting_duplicates as FD
from readq.llm import language_id as LI
from readq.llm import linked_splits as LS
from readq.llm import reading_level as RL
from readq.llm import response_defects as RD
from readq.llm import source_mixing as SM

QDE = "rec_id BIGINT, passage STRING, question STRING, answer STRING, difficulty STRING, source STRING, split STRING, author STRING"
#: Names that the operators use inside.
CLASH = ("key", "k", "u", "v", "rec", "size", "text", "group_id", "band", "shard", "batch", "bucket", "word", "named", "label", "draw", "slice", "container", "judge", "at")


def clashing(df):
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# ---- 1: consensus ----

JUDGED = "qg_id BIGINT, llm_diff_judge MAP<STRING, STRUCT<question_cognitive_diff: DOUBLE>>, annotated_at TIMESTAMP"


def test_consensus_finds_truth_among_bad_judges(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 1500)
    rows = []
    for i, t in enumerate(truth):
        votes = {}
        for name, right in (("a", 0.9), ("b", 0.85), ("c", 0.8), ("d", 0.75)):
            votes[name] = t if rng.random() < right else int(rng.integers(0, 3))
        votes["inverts"] = 2 - t if rng.random() < 0.9 else int(rng.integers(0, 3))
        votes["random"] = int(rng.integers(0, 3))
        rows.append((i, {j: (float(v) / 3 + 0.15,) for j, v in votes.items()}, None))
    c = AC.Consensus(clashing(spark.createDataFrame(rows, JUDGED)), min_judges=3)
    got = {r["item"]: r["label"] for r in c.labels().collect()}
    assert np.mean([got[i] == AC.LABELS[t] for i, t in enumerate(truth)]) > 0.93
    rel = {r["judge"]: r["reliability"] for r in c.judges().collect()}
    assert rel["a"] > rel["d"] > 0.4 and abs(rel["random"]) < 0.1 and rel["inverts"] < 0.2


def test_consensus_merges_deliveries_and_ranges(spark):
    import datetime as dt

    d1, d2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [
        (1, {"A ": (0.1,), "b": (95.0,), "c": (0.9,)}, d1), (1, {"a": (0.9,), "c": (None,)}, d2), (1, {"a": (0.9,), "c": (None,)}, d2),
        (2, {"a": (0.9,), "b": (-1.0,)}, d1), (3, None, d1), (4, {}, None), (None, {"a": (0.5,)}, d1), (5, {"a": (float("nan"),), "": (0.5,)}, d1),
    ]
    df = spark.createDataFrame(rows, JUDGED)
    got = {(r["item"], r["judge"]): r["score"] for r in AC.latest_scores(df).collect()}
    assert got == {(1, "a"): 0.9, (1, "b"): 95.0, (1, "c"): 0.9, (2, "a"): 0.9}
    c = AC.Consensus(df)
    assert {r["item"]: r["n_judges"] for r in c.labels().collect()} == {1: 3, 2: 1}
    assert AC.Consensus(df.limit(0)).labels().count() == 0 and AC.Consensus(df.limit(0)).judges().count() == 0


def test_views_tell_which_neighbour_a_judge_errs_towards(spark):
    rng = np.random.default_rng(8)
    truth = rng.choice(3, 6000, p=[0.35, 0.4, 0.25])
    fair, lenient, strict = ([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]], [[0.92, 0.07, 0.01], [0.4, 0.55, 0.05], [0.05, 0.45, 0.5]], [[0.5, 0.4, 0.1], [0.05, 0.55, 0.4], [0.01, 0.07, 0.92]])
    tables = [np.array(t) for t in (fair, lenient, strict, fair, lenient, strict)]
    rows = [(i, {f"j{j}": (float(rng.choice(3, p=t[y])) / 3 + 0.15,) for j, t in enumerate(tables) if rng.random() < 0.8}, None) for i, y in enumerate(truth.tolist())]
    df = spark.createDataFrame(rows, JUDGED)
    pairs, views = AC.Consensus(df, deals=0), AC.Consensus(df)
    gap = lambda c: np.mean([np.abs(c.table[c.names.index(f"j{j}")] - t).mean() for j, t in enumerate(tables)])
    assert gap(views) < 0.03 and gap(views) < 0.7 * gap(pairs)


def test_a_stray_score_does_not_stretch_a_range(spark):
    assert AC.judge_range(1000, [999, 1000, 1000, 1000, 1000], 1.5) == 1.0
    assert AC.judge_range(1000, [300, 990, 999, 1000, 1000], 50.0) == 10.0
    assert AC.judge_range(3, [2, 3, 3, 3, 3], 4.0) == 5.0 and AC.judge_range(2, [0] * 5, 4000.0) == 4000.0


# ---- 2: mixing ----

TARGETS = "mix_id STRING, source STRING, difficulty STRING, weight DOUBLE, max_repeats INT, size_ratio DOUBLE"


def test_mixing_reaches_shares_within_caps(spark):
    rows = [(i, "x" * 10, None, "", "EASY" if i % 2 else "HARD", "big" if i < 900 else " Small-One ", "train", None) for i in range(1000)]
    qde = clashing(spark.createDataFrame(rows + rows[:5] + [(None, "x", "", "", "EASY", "big", "train", None)], QDE))
    targets = clashing(spark.createDataFrame([("m", "big", None, 1.0, 1, 0.5), ("m", "small_one", None, 1.0, 2, 0.5), ("m", "none", None, 1.0, 3, 0.5), ("e", "big", "EASY", 1.0, 1, 0.2), ("e", "big", None, 1.0, 1, 0.2), ("z", "big", None, None, 1, 1.0)], TARGETS))
    mix = SM.SourceMix(SM.record_sizes(qde), targets)
    got = mix.chosen().collect()
    amount = {}
    for r in got:
        key = (r["mix_id"], r["source"], r["difficulty"])
        amount[key] = amount.get(key, 0) + r["size"] * r["repeats"]
    # 5000 wanted in m: a third each; small_one gives at most 2000 and takes it, none gives nothing, big takes the rest.
    assert amount[("m", "small_one", None)] == 2000 and amount[("m", "big", None)] == 3000
    assert amount[("e", "big", "EASY")] == 1000 and amount[("e", "big", None)] == 1000
    easy = {r["rec_id"] for r in got if (r["mix_id"], r["difficulty"]) == ("e", "EASY")}
    other = {r["rec_id"] for r in got if r["mix_id"] == "e" and r["difficulty"] is None}
    assert not easy & other and all(i % 2 for i in easy)
    assert max(r["repeats"] for r in got) == 2 and all(r["repeats"] == 1 for r in got if r["source"] == "big")
    assert {tuple(r) for r in mix.chosen().collect()} == {tuple(r) for r in got}
    shares = {(r["mix_id"], r["source"], r["difficulty"]): r["reached_share"] for r in mix.shares().collect()}
    assert shares[("m", "big", None)] == 0.6 and shares[("m", "none", None)] == 0.0
    assert SM.SourceMix(SM.record_sizes(qde.limit(0)), targets).chosen().count() == 0
    assert SM.SourceMix(SM.record_sizes(qde), targets.limit(0)).shares().count() == 0


# ---- 3: overlap ----

VOCAB = [f"w{i}" for i in range(400)]


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [rng.choice(VOCAB)] if x < 2 * share / 3 else [w, rng.choice(VOCAB)] if x < share else [w]
    return out


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(120):
        base = [rng.choice(VOCAB) for _ in range(rng.choice((1, 5, 12, 30, 120)))]
        q = [rng.choice(VOCAB) for _ in range(rng.randint(3, 10))]
        for k in range(3):
            p = base if k == 0 else edited(rng, base, rng.choice((0, 0.05, 0.12, 0.3)))
            qq = q if k < 2 else edited(rng, q, 0.2)
            text = " ".join(p).upper() + "!" if k else ", ".join(p)
            n += 1
            rows.append((n, text, " ".join(qq) + "?", "", "", "s", rng.choice(("train", "val", "test ")), None))
    rows += rows[:4] + [(n + 1, None, "q", "", "", "s", "train", None), (n + 2, "p", "​", "", "", "s", "val", None), (n + 3, "p", "q", "", "", None, None, None), (None, "p", "q", "", "", "s", "val", None)]
    df = clashing(spark.createDataFrame(rows, QDE))
    got = {(r["train_id"], r["eval_id"]) for r in CO.overlapping_records(df).collect()}
    plain = {r[0]: (CO.plain_words(r[1]).split(), CO.plain_words(r[2]).split(), r[6].strip() if r[6] else None) for r in rows if r[0]}
    want = {(a, b) for a, x in plain.items() if x[2] == "train" for b, y in plain.items() if y[2] in ("val", "test") and CO.near(x[0], y[0]) and CO.near(x[1], y[1])}
    assert want and got == want
    assert CO.overlap_report(df).agg(F.sum("pairs")).first()[0] == len(want)
    assert CO.overlapping_records(df.limit(0)).count() == 0


def test_hot_passage_keeps_all_pairs(spark):
    rows = [(i, "one two three four five six", f"what is number {i % 7} of them", "", "", "s", "val" if i % 3 == 0 else "train", None) for i in range(300)]
    pairs = CO.overlapping_records(spark.createDataFrame(rows, QDE))
    want = sum(1 for a in range(300) for b in range(300) if a % 3 and b % 3 == 0)  # five of six words agree in any two questions
    assert pairs.count() == want


def test_overlap_of_a_hot_family_and_of_placed_edits(spark):
    rng = random.Random(6)
    base = [rng.choice(VOCAB) for _ in range(150)]
    changed = lambda share: [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base]
    texts = [changed(0.1) for _ in range(25)] + [changed(0.17) for _ in range(25)]
    # No run of five words is left.
    texts += [["y" if i % 5 == k else w for i, w in enumerate(base)] for k in range(5)]
    train = [base, changed(0.05)]
    rows = [(i, " ".join(t), "what is it", "", "", "s", "train" if i < 2 else "val", None) for i, t in enumerate(train + texts)]
    got = {(r["train_id"], r["eval_id"]) for r in CO.overlapping_records(spark.createDataFrame(rows, QDE)).collect()}
    want = {(a, b) for a, x in enumerate(train) for b, y in enumerate(texts, 2) if CO.near(x, y)}
    assert len(want) > 60 and got == want


def test_long_text_is_scanned_whole(spark):
    rng = random.Random(1)
    words = [rng.choice(VOCAB) for _ in range(30_000)]
    other = words[:29_000] + ["x"] * 1000
    half = words[:15_000] + ["y"] * 15_000
    rows = [(1, " ".join(words), "q q", "", "", "s", "train", None), (2, " ".join(other), "q q", "", "", "s", "test", None), (3, " ".join(half), "q q", "", "", "s", "test", None)]
    assert [(r["train_id"], r["eval_id"]) for r in CO.overlapping_records(spark.createDataFrame(rows, QDE)).collect()] == [(1, 2)]



def templated(rng, n, names=30):
    """Passages of few words in many combinations, so that all of them share most words."""
    frames = [[rng.choice(VOCAB) for _ in range(rng.randint(5, 9))] for _ in range(60)]
    return [" ".join(w for _ in range(15) for f in [rng.choice(frames)] for w in (*f, f"n{rng.randrange(names)}", rng.choice(VOCAB), f"m{i % 9}")) for i in range(n)]


@pytest.mark.parametrize("row_bytes", (64, 30_000, 24_000_000))
def test_overlap_filter_is_exact_with_shared_rows(monkeypatch, row_bytes):
    monkeypatch.setattr(CO, "ROW_BYTES", row_bytes)
    rng = random.Random(8)
    passages = [*templated(rng, 150), "one", "a b", "a b c", "one two three four five"]
    near = [" ".join(edited(rng, t.split(), rng.choice((0.05, 0.15, 0.2)))) or "x" for t in passages]
    texts = list(dict.fromkeys(near + templated(rng, 50) + ["one", "a b", "a c", "unheard of"]))
    shard, held = CO.Shard(passages, passages), CO.Held(texts, texts)
    got = [(held.texts[t], shard.texts[c]) for t, some in shard.candidates(held, 0, len(texts)) for c in some]
    want = {(t, p) for t in texts for p in passages if CO.near(t.split(), p.split())}
    assert len(want) > 100 and want <= set(got) and len(got) == len(set(got))


def test_overlap_by_many_shards_and_styles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(CO, "SHARD_WORDS", 1500)
    rng = random.Random(9)
    base = templated(rng, 60)
    longer = [" ".join(w + "long" * (i % 4) for w in t.split()) for i, t in enumerate(base)]
    texts = longer + [" ".join(edited(rng, t.split(), rng.choice((0.1, 0.2)))) for t in longer]
    rows = [(i, t, "what is it", "", "", "s", "train" if i < 60 else "val", None) for i, t in enumerate(texts)]
    got = {(r["train_id"], r["eval_id"]) for r in CO.overlapping_records(spark.createDataFrame(rows, QDE)).collect()}
    assert got == {(a, b) for a in range(60) for b in range(60, 120) if CO.near(texts[a].split(), texts[b].split())} and len(got) > 30


def test_overlap_takes_little_time_for_each_pair_of_passages():
    rng = random.Random(10)
    passages, texts = templated(rng, 8000), templated(rng, 1000)
    shard, held = CO.Shard(passages, passages), CO.Held(texts, texts)
    took = []
    for _ in range(3):
        began = time.thread_time()
        assert not list(shard.candidates(held, 0, len(texts)))
        took.append(time.thread_time() - began)
    began = time.thread_time()
    sum(range(5_000_000))
    # Eight million pairs took 0.16 of that sum, and 1.6 when automata scanned each text for each shard.
    assert min(took) < 0.5 * (time.thread_time() - began)


# ---- 4: formatting ----


def lines(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows, 1)], "line_id BIGINT, line STRING")


SOUND = '{"passage": "A b.", "question": "Q?", "answer": null, "difficulty": "EASY", "source": "s"}'


def test_lines_that_are_no_records(spark):
    bad = [None, "", "  ", SOUND[:-5], "[" + SOUND + "]", SOUND + SOUND, SOUND + " x", '{"passage": "A b."}', "null", "{}", '"text"']
    assert FD.canonical_lines(lines(spark, bad)).count() == 0
    assert FD.canonical_lines(lines(spark, [SOUND, " " + SOUND + "\n", SOUND.replace(": ", " :\t")])).count() == 3


def test_ledger_counts_over_batches(spark):
    same = [SOUND, SOUND.upper().replace("PASSAGE", "passage").replace("QUESTION", "question").replace("ANSWER", "answer").replace("DIFFICULTY", "difficulty").replace("SOURCE", "source").replace("NULL", "null"),
            '{"source": "S", "answer": "", "question": "q", "difficulty": "easy!", "passage": "a​ B"}']
    other = [SOUND.replace("A b", "A c"), SOUND.replace("EASY", "HARD")]
    keys = FD.canonical_lines(clashing(lines(spark, other + same + same)))
    ledger = FD.CopyLedger(spark, bucket_keys=1)
    ledger.add(keys.where("line_id % 2 = 0"))
    ledger.add(keys.where("line_id % 2 = 1"))
    ledger.add(keys.limit(0))
    assert sorted((r["copies"], r["keep_id"]) for r in ledger.rows().collect()) == [(1, 1), (1, 2), (6, 3)]
    assert ledger.buckets == 4
    assert FD.CopyLedger(spark).rows().count() == 0
    want = [(3, i) for i in range(4, 9)]
    for hot in (1, 10_000):  # joined by key, and broadcast
        assert sorted(tuple(r) for r in FD.duplicate_lines(keys, ledger, hot).collect()) == want


# ---- 5: linked splits ----


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(b)] = find(a)
    return find


def test_rows_of_one_id_with_nulls_link(spark):
    rows = [(1, "alpha", None), (2, "alpha", None), (2, None, "Ann Lee"), (3, None, "Lee, Ann"), (4, "beta", None), (4, None, None)]
    groups = LS.linked_groups(spark.createDataFrame(rows, "rec_id BIGINT, passage STRING, author STRING"))
    assert {r["rec_id"]: r["group_id"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_contraction_equals_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["v"]: r["rep"] for r in LS.contract(spark.createDataFrame(pairs, "u BIGINT, v BIGINT")).collect()}
    find = components(pairs)
    sets = {}
    for v in {x for p in pairs for x in p}:
        sets.setdefault(find(v), set()).add(got.get(v, v))
    assert all(len(s) == 1 for s in sets.values()) and len({next(iter(s)) for s in sets.values()}) == len(sets)


def test_groups_and_splits(spark):
    rows = [
        (1, "A text.", "", "", "", "", "", "Ann Lee"), (2, "a TEXT", "", "", "", "", "", "Unknown"), (3, "other", "", "", "", "", "", "Lee, Ann"), (4, " . ", "", "", "", "", "", "N/A"), (5, None, "", "", "", "", "", None),
        (6, "other​", "", "", "", "", "", None), (7, "seven", "", "", "", "", "", "unknown"), (7, "eight", "", "", "", "", "", None), (8, "eight", "", "", "", "", "", None), (8, "eight", "", "", "", "", "", None), (None, "A text", "", "", "", "", "", None),
    ]
    df = clashing(spark.createDataFrame(rows, QDE))
    groups = LS.linked_groups(df)
    assert {r["rec_id"]: r["group_id"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 5, 7: 7, 8: 7}
    big = spark.range(1000).select((F.when(F.col("id") < 350, 0).otherwise(F.col("id") - F.col("id") % 3)).alias("group_id"), F.col("id").alias("rec_id"))
    shares = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", 0.0), (None, 1.0)], "split STRING, share DOUBLE")
    out = LS.split_groups(big, shares)
    assert out.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] - 800) <= 5 and abs(n["val"] - 100) <= 5 and sum(n.values()) == 1000
    assert LS.linked_groups(df.limit(0)).count() == 0


# ---- 6: defects ----

PAIRS = "qg_id BIGINT, question STRING, answer STRING, passage STRING, lang STRING"
EN = "The old baker walked to the market because his daughter wanted some apples. Nobody in the village knew where the lamp was. Anna carried the heavy box to the station and waited for the train."
DE = "Der alte Bäcker ging zum Markt, weil seine Tochter ein paar Äpfel wollte. Niemand im Dorf wusste, wo die Lampe war. Anna trug die schwere Kiste zum Bahnhof und wartete auf den Zug."
FR = "Le vieux boulanger allait au marché parce que sa fille voulait des pommes. Personne dans le village ne savait où était la lampe. Anna porta la caisse lourde à la gare et attendit le train."


@pytest.fixture(scope="module")
def defects(spark):
    rows = [(i, q, "x", p, lang) for i in range(60) for q, p, lang in (("Why did the baker walk to the market?", EN, "en"), ("Warum ging der Bäcker zum Markt?", DE, "de"), ("Pourquoi le boulanger allait-il au marché ?", FR, "fr"))]
    return RD.train(spark.createDataFrame(rows, PAIRS))


@pytest.mark.parametrize("answer,want", [
    (None, "empty"), ("  ", "empty"), ("…", "empty"), ("N/A", "empty"), ("Why did the baker walk to the market?", "copy"), ("Q: why did the baker walk to the market", "copy"),
    ("I'm sorry, but I cannot answer this question.", "refusal"), ("Unfortunately, I am unable to help with that.", "refusal"), ("Niemand im Dorf wusste, wo die Lampe war.", "language"),
    ("Anna carried the heavy box to the sta", "truncated"), ("The old baker walked to the...", "truncated"), ("Nobody in the village knew where the lamp was.", None), ("Anna", None), ("1984", None), ("because his daughter wanted some apples", None),
    ("\"I'm sorry, but I can't come,\" said Anna.", None),
])
def test_defects(defects, answer, want):
    assert defects.defect("Why did the baker walk to the market?", answer, EN) == want


def test_defects_of_a_table(spark, defects):
    rows = [(1, "Why did he walk?", None, None, None), (2, None, "x", EN, "en"), (3, " ", "x", EN, "en"), (4, "Why did the baker walk to the market?", "word " * 20_000, EN, "en"), (1, "Why did he walk?", None, None, None)]
    df = clashing(spark.createDataFrame(rows, PAIRS))
    assert sorted(r["qg_id"] for r in RD.response_defects(df, defects).collect()) == [1, 1, 4]
    assert RD.response_defects(df.limit(0), defects).count() == 0
    assert RD.train(df.limit(0)).defect("Why?", None, None) == "empty"


def test_ends_of_clauses_are_counted_on_all_passages(spark):
    rows = [(f"What is {i}?", f"The bird number{i} sang, and it flew home to word{i % 2000}.") for i in range(4000)]
    model = RD.train(spark.createDataFrame([(i, q, None, p, "en") for i, (q, p) in enumerate(rows)], "qg_id BIGINT, question STRING, answer STRING, passage STRING, lang STRING"))
    assert all(f"word{k}" in model.setting.ends for k in range(2000))


# ---- 7: reading level ----


def test_isotonic_is_monotone_least_squares():
    x, y = RL.isotonic(np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == 0.5 and np.interp(9, x, y) == 1


def test_levels(spark):
    rng = random.Random(4)
    words = {1: "cat dog sun run red".split(), 2: "garden window travel listen bridge".split(), 3: "economy principle evidence committee".split()}
    make = lambda level: " ".join(rng.choice(words[level]) for _ in range(30)) + "."
    graded = spark.createDataFrame([(i, make(i % 3 + 1), i % 3 + 1) for i in range(90)] + [(900, None, 1), (901, "x", None)], "sample_id INT, passage STRING, level INT")
    model = RL.train(clashing(graded))
    rows = [(i, make(i % 3 + 1)) for i in range(60)] + [(100, None), (101, " ​ "), (102, "!!"), (103, make(1) * 2000)]
    got = {r["rec_id"]: r["level"] for r in RL.reading_levels(clashing(spark.createDataFrame(rows, "rec_id INT, passage STRING")), model).collect()}
    assert model.held_out > 0.95 and all(got[i] == i % 3 + 1 for i in range(60))
    assert 100 not in got and 101 not in got and got[102] == 1 and got[103] == 1
    assert RL.reading_levels(spark.createDataFrame([], "rec_id INT, passage STRING"), model).count() == 0
    assert RL.LevelModel([]).score(["x"])[0].tolist() == [1]


# ---- 8: encoding ----


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = BE.load_ranks(BE.read_vocabulary(BE.vocabulary()))
    return BE.TextEncoder(ranks), tiktoken.Encoding("own", pat_str=BE.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_merging(reference):
    own, other = reference
    rng = random.Random(6)
    texts = ["", "a", "<|endoftext|>", " " * 500, "a" * 3000, "日本語" * 300, "é́" * 50, "👩‍🏫\n\n\tx  "]
    texts += ["".join(rng.choice("aabcdeeehlnorst ABC'äß日й 12.,!?\n") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert all(own.encode(t) == other.encode_ordinary(t) for t in texts)


def test_prefixes_are_kept_for_appends_and_edits(reference):
    e = reference[0].encoder
    text = b" incomprehensibilities"
    last = e.last_tokens(text)
    assert e.last_tokens(text, last[:7]) == last
    assert e.read_back(last[:9]) == e.read_back(e.last_tokens(text[:9]))


def test_encoding_of_a_table(spark, reference):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (4, "x" * 100_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    got = sorted((r["doc_id"], r["ids"]) for r in BE.encode_texts(df).collect())
    assert got[:4] == [(1, [15496, 995]), (2, []), (3, []), (3, [])] and got[4][1] == reference[1].encode_ordinary("x" * 100_000)
    assert sorted((r["doc_id"], r["size"]) for r in BE.count_tokens(df).collect())[:2] == [(1, 2), (2, 0)]
    assert BE.encode_texts(df.limit(0)).count() == 0


def test_vocabularies_that_cannot_be_used(spark):
    with pytest.raises(ValueError):
        BE.read_vocabulary(BE.vocabulary("no_such_one"))
    with pytest.raises(ValueError):
        BE.read_vocabulary(f"{BE.TOKENIZER_DIR}/word_bpe_49k.json")


def test_memo_is_bounded_by_bytes():
    from readq.llm.memo import Memo

    memo = Memo(10_000)
    for i in range(100):
        memo[f"{i}" + "x" * 1000] = i
        assert memo.used <= 10_000 and len(memo) < 6
    memo["a", "b"] = 1
    assert memo["a", "b"] == 1


# ---- 9: containers ----


@pytest.mark.parametrize("capacity,shape", [(100, "small"), (512, "mixed"), (4096, "mixed"), (7, "equal"), (50, "large")])
def test_plan_fills_containers(capacity, shape):
    rng = np.random.default_rng(8)
    n = 3000
    sizes = {"small": rng.integers(1, capacity // 3, n), "mixed": np.minimum(rng.lognormal(4, 1.2, n).astype(int) + 1, capacity), "equal": np.full(n, 3), "large": rng.integers(capacity // 2 + 1, capacity + 1, n)}[shape]
    plan = CP.PackingPlan(np.bincount(sizes, minlength=capacity + 1), capacity)
    order = np.argsort(sizes, kind="stable")
    s = sizes[order]
    index = np.arange(n) - np.searchsorted(s, s)
    fill = np.bincount(plan.place(s, index), weights=s, minlength=plan.containers)
    assert fill.max() <= capacity and fill.min() > 0 and len(fill) == plan.containers
    # First fit, largest first, is the plain way; the plan is not worse by more than 2 %.
    rooms = []
    for x in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= x), None)
        if at is None:
            rooms.append(capacity - x)
        else:
            rooms[at] -= x
    assert plan.containers <= 1.02 * len(rooms) + 1


def test_packing_of_a_table(spark):
    rows = [(i, i % 40) for i in range(500)] + [(1000, 230), (1001, 200), (1002, None)]
    df = clashing(spark.createDataFrame(rows, "doc_id BIGINT, size INT"))
    got = CP.pack(df, 100).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r["size"])
    assert sorted(pieces[1000]) == [30, 100, 100] and sorted(pieces[1001]) == [100, 100] and pieces[1002] == [0]
    assert all(len(v) == 1 for k, v in pieces.items() if k < 1000) and len(pieces) == 503
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) == 100
    assert CP.pack(df.limit(0), 100).count() == 0
    assert {r["container"] for r in CP.pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id BIGINT, size INT"), 9).collect()} == {0}
    with pytest.raises(ValueError):
        CP.PackingPlan(np.zeros(1), 0)


def test_too_many_kinds_of_container(spark, tmp_path):
    from readq.llm.queries import p9_bins

    rows = spark.range(1001).select(F.format_string("k%04d", "id").alias("bin_kind"), F.lit("byte_bpe_50k").alias("tokenizer"), F.lit(9).alias("capacity"))
    rows.write.parquet(f"{tmp_path}/bin_sizes.parquet")
    with pytest.raises(ValueError):
        p9_bins(spark, str(tmp_path))


# ---- 10: languages ----


@pytest.fixture(scope="module")
def filters(spark):
    rows = [(p, lang) for p, lang in ((EN, "en"), (DE, "Deutsch"), (FR, "fr-CA")) for _ in range(3)] + [(EN, "sw"), (None, "en"), ("", None)]
    return LI.fit_filter(spark.createDataFrame(rows, "text STRING, lang STRING"))


def test_labels():
    assert [LI.label_code(x) for x in ("en", " EN-gb", "Deutsch", "por", "xx", "", None, "mul", "русский")] == ["en", "en", "de", "pt", None, None, None, None, "ru"]


def test_stretches(spark, filters):
    en, de = EN.split(". "), DE.split(". ")
    quoted = f"{en[0]}. {en[1]}. {de[1]}. {EN}"
    rows = [
        (1, EN, "en"), (2, EN, "English"), (3, DE, "en"), (4, EN, None), (5, EN + "\n" + DE, "en"), (6, DE + " / " + EN + " " + FR, "mul"), (7, quoted, "en"),
        (8, None, "en"), (9, "", None), (10, "*** 123 😀", None), (11, EN * 3000, "de"), (12, "The old bak​er walked to the market.", " "), (4, EN, None),
    ]
    df = clashing(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    found = LI.label_cases(LI.language_stretches(df, filters, label_col="lang"))
    got = sorted((r["doc_id"], r["seg_no"], r["lang"]) for r in found.collect())
    assert got == [(3, 0, "de"), (4, 0, "en"), (4, 0, "en"), (5, 1, "en"), (5, 2, "de"), (6, 1, "de"), (6, 2, "en"), (6, 3, "fr"), (11, 0, "en"), (12, 0, "en")]
    ends = {(r["doc_id"], r["seg_no"]): (r["first"], r["last"]) for r in found.collect()}
    assert ends[5, 1][1] == ends[5, 2][0] and abs(ends[5, 1][1] - len(EN)) <= 1
    assert LI.language_stretches(df.limit(0), filters).count() == 0
    assert LI.language_stretches(df, LI.fit_filter(df.limit(0).select("text", "lang"))).count() == 0


def test_filter_has_few_false_positives(filters):
    rng = np.random.default_rng(9)
    masks = filters.masks(rng.integers(0, 2**63, 100_000, dtype=np.uint64))
    assert (masks > 0).mean() < 0.001


def test_refusals_worded_otherwise(spark):
    """Recall on statements, openings and closings that neither the field nor its words have seen, in nine languages."""
    texts = {"en": EN, "de": DE, "fr": FR}
    rows = [(i, f"What did the baker do on day {i}?", None, texts[lang], lang) for i in range(60) for lang in texts]
    df = spark.createDataFrame(rows, PAIRS)
    shown = {code: tuple(p[:2] + p[3:] for p in parts[:2]) + (parts[2],) for code, parts in RD.REFUSALS.items()}
    model = RD.DefectModel(RD.Setting(LI.fit_filter(df, "passage", "lang"), []), [(r[1], r[3]) for r in rows], refusals=shown)
    held = [(code, f"{parts[0][2]} {parts[1][2]}.") for code, parts in RD.REFUSALS.items() if code in texts]
    found = [model.defect("What did the baker do?", a, texts[code]) for code, a in held]
    assert found.count("refusal") >= 2, list(zip(held, found))
