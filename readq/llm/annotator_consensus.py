"""Consensus from several annotators' labels (problem 1).

The deliveries of a record are merged judge by judge, each score is brought to 0..1 by the range its judge uses and read as
a vote. The reliability of each judge comes from the triplet moment method: for a class, the rate at which two judges both
name it, less the rate expected by chance, is the product of what each of them knows about the class; so of three judges,
the product of two such rates over the third is the square of one judge's own factor. The factors of all triplets are
averaged, their signs come from the leading eigenvector (most judges being better than chance), and each judge's votes get
their probability under each class from the same moments.

Pairs tell a class only from the two others together. Which neighbour a judge errs towards comes from moments of three views:
the judges are dealt into three parts, each part's votes give a record a view (the log-odds sum of the triplets, as shares),
and the sums of view x view x vote are solved for the whole confusion matrix of each judge (`view_moments`). These are
moments like the pair rates, solved once, in closed form; no consensus is fed back. Votes are combined by adding the log-odds
of these probabilities, so a judge who turns the scale around counts turned around, and one who knows nothing counts nothing.

A judge's range is the least of RANGES that holds all scores but STRAY of them, so single stray scores do not stretch it.

Only sums over pairs of judges leave the executors: their number is bounded by the number of judges, not by the records.

Defined results: null ids, maps, judges' names, scores, negative and non-finite scores are no votes. Judges' names are
compared without case and surrounding blanks. Of several scores of one judge for one record the latest usable one holds (ties:
the higher). Judges who share too few records with others carry no weight. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readq.session import materialise

LABELS = ("EASY", "MEDIUM", "HARD")
K = len(LABELS)
#: Ends of the ranges in which judges may score.
RANGES = (1.0, 5.0, 10.0, 100.0, 1000.0)
#: So many judges are solved for; more raise an error, as the pair sums are held by the driver.
MAX_JUDGES = 400
#: Pairs of judges with fewer records in common say nothing.
MIN_OVERLAP = 20
#: This share of a judge's scores, and one score in any case from 20 on, may lie above the range.
STRAY = 0.005
#: The judges are dealt into three parts so many times, by a hash of name and deal.
DEALS = 6
#: Votes of a judge at which the moments of three views weigh as much as those of pairs.
FEW_VOTES = 200


def latest_scores(df: DataFrame, field: str = "question_cognitive_diff", id_col: str = "qg_id", map_col: str = "llm_diff_judge", time_col: str = "annotated_at") -> DataFrame:
    """(item, judge, score): the usable scores over all deliveries."""
    each = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(time_col).alias("at"), F.explode(map_col).alias("name", "scores"))
    each = each.select("item", "at", F.trim(F.lower(F.regexp_replace("name", r"[\p{Z}\s\p{Cf}]+", " "))).alias("judge"), F.col("scores")[field].cast("double").alias("score"))
    usable = each.where("judge <> '' AND score >= 0 AND NOT isnan(score) AND score < double('infinity')")
    return usable.groupBy("item", "judge").agg(F.max_by("score", F.struct("at", "score")).alias("score"))


def judge_range(n: int, within: list[int], most: float) -> float:
    """The end of the range of a judge with n scores, so many of them within each of RANGES."""
    stray = max(int(STRAY * n), int(n >= 20))
    return next((x for x, k in zip(RANGES, within) if k >= n - stray), float(most))


class TripletModel:
    """Vote probabilities of each judge under each class, from pair sums."""

    def __init__(self, judges: list[str], pairs: np.ndarray):
        """pairs[i, a, j, b]: records on which judge i voted a and judge j voted b (i <> j); pairs[i, a, i, a]: votes of judge i."""
        self.judges, n = judges, len(judges)
        own = np.array([[pairs[i, a, i, a] for a in range(K)] for i in range(n)]).reshape(n, K).astype(float)
        self.votes = own.sum(1)
        self.marginal = own / np.maximum(self.votes, 1)[:, None]
        both = pairs.sum(axis=(1, 3)).astype(float)  # records in common
        np.fill_diagonal(both, 0)
        with np.errstate(all="ignore"):
            joint = pairs / both[:, None, :, None]
            first, second = joint.sum(3, keepdims=True), joint.sum(1, keepdims=True)
            excess = np.nan_to_num(joint - first * second)  # agreement beyond chance
        weight = np.where(both >= MIN_OVERLAP, both, 0.0)
        self.factor = np.zeros((n, K))  # what judge i knows of class k, times sqrt(share * (1 - share))
        self.slope = np.zeros((n, K, K))  # [i, vote, class]
        for k in range(K):
            c = excess[:, k, :, k]
            self.factor[:, k] = g = self._triplets(c, weight)
            for i in range(n):
                w = weight[i] * g * g
                if w.sum() > 0:
                    self.slope[i, :, k] = (excess[i, :, :, k] * (weight[i] * g)[None, :]).sum(1) / w.sum()
        trust = (self.factor**2).sum(1) * self.votes
        self.share = (self.marginal * trust[:, None]).sum(0) / trust.sum() if trust.sum() > 0 else np.full(K, 1 / K)

    @staticmethod
    def _triplets(c: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The factors g with c[i, j] = g[i] g[j]. For judge i, all pairs (j, k) of others give c[i,j] c[i,k] = g[i]^2 c[j,k]; the
        slope of that line over all pairs, weighted by the records in common, is g[i]^2."""
        n = len(c)
        g = np.zeros(n)
        for i in range(n):
            o = [j for j in range(n) if j != i and weight[i, j] > 0]
            x, y = c[np.ix_(o, o)], np.outer(c[i, o], c[i, o])
            w = np.sqrt(np.outer(weight[i, o], weight[i, o])) * (weight[np.ix_(o, o)] > 0)
            low = (w * x * x).sum()
            g[i] = np.sqrt(max((w * x * y).sum() / low, 0.0)) if low > 0 else 0.0
        if not g.any():
            return g
        m = np.where(weight > 0, c, 0.0)
        _, vectors = np.linalg.eigh((m + m.T) / 2)
        sign = np.sign(vectors[:, -1])
        return g * sign * (1 if (g * sign * weight.sum(1)).sum() >= 0 else -1)

    def probabilities(self, share: np.ndarray) -> np.ndarray:
        """[judge, class, vote], rows summing to 1: chance plus what the vote's slope adds under the class; with few votes, mostly chance."""
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-6))
        p = self.marginal[:, None, :] + (self.slope / spread[None, None, :]).transpose(0, 2, 1) * (1 - share)[None, :, None]
        p = np.clip(p, 0.004, 1)
        p /= p.sum(2, keepdims=True)
        n = self.votes[:, None, None]
        mixed = (n * p + 10 * np.maximum(self.marginal[:, None, :], 1e-3)) / (n + 10)
        return mixed / mixed.sum(2, keepdims=True)


def reliability(share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each judge, corrected for chance: 1 if every vote hits the class, 0 for blind votes, below 0 for misleading ones. It is
    the kappa of vote and class that the probabilities imply."""
    hit = np.einsum("k,ikk->i", share, table)
    chance = np.einsum("k,ik->i", share, np.einsum("k,ikv->iv", share, table))
    return (hit - chance) / np.maximum(1 - chance, 1e-9)


def solve_views(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(shares, first, second): shares of the classes, and the mean of the first and the second view under each class (in columns), from
    total[i, j, k], the sums of first x second x third view. Slices along the third view, over their sum, are diagonal in the same
    base, whose columns are the first view's means. None where the views say too little."""
    pair = total.sum(2)
    pair = pair / max(pair.sum(), 1e-12)
    if np.linalg.cond(pair) > 1e4:
        return None
    turn = np.linalg.inv(pair)
    slices = [total[:, :, k] / max(total.sum(), 1e-12) @ turn for k in range(K)]
    # A mix of slices whose eigenvalues lie apart: of some fixed mixes, the one with the largest least gap.
    best, base = 0.0, None
    for mix in np.random.default_rng(1).normal(size=(24, K)):
        values, vectors = np.linalg.eig(sum(m * x for m, x in zip(mix, slices)))
        if np.abs(values.imag).max() > 1e-9:
            continue
        v = np.sort(values.real)
        gap = float(np.diff(v).min() / max(v[-1] - v[0], 1e-12))
        if gap > best:
            best, base = gap, vectors.real
    if base is None or np.abs(base.sum(0)).min() < 1e-6:
        return None
    base = base / base.sum(0)  # views are shares
    order = np.argmax(base, 0)
    if len(set(order.tolist())) < K or base.min() < -0.1:
        return None
    first = np.empty_like(base)
    first[:, order] = base
    share = np.linalg.solve(first, pair.sum(1))
    if share.min() <= 0:
        return None
    second = np.linalg.solve(first, pair).T / share
    return share, first, second


def deal(names: list[str], round_: int) -> np.ndarray:
    """The part, 0 to 2, of each judge: equal parts in the order of a hash."""
    order = np.argsort([zlib.crc32(f"{round_}|{name}".encode()) for name in names], kind="stable")
    part = np.empty(len(names), dtype=int)
    part[order] = np.arange(len(names)) % 3
    return part


class Consensus:
    """Labels, agreement and reliabilities for a table of records with judges' scores."""

    def __init__(self, df: DataFrame, min_judges: int = 1, deals: int = DEALS, **columns: str):
        """deals: how often the judges are dealt into three parts; 0 leaves what pairs give."""
        spark = df.sparkSession
        self.spark, self.min_judges = spark, min_judges
        scores = materialise(latest_scores(df, **columns), "scores")
        within = [F.count(F.when(F.col("score") <= x, 1)).alias(f"r{i}") for i, x in enumerate(RANGES)]
        stats = scores.groupBy("judge").agg(F.max("score").alias("most"), F.count("*").alias("n"), *within).orderBy("judge").limit(MAX_JUDGES + 1).collect()
        if len(stats) > MAX_JUDGES:
            raise ValueError(f"more than {MAX_JUDGES} judges")
        self.names = [r["judge"] for r in stats]
        ranges = [(r["judge"], i, judge_range(r["n"], [r[f"r{x}"] for x in range(len(RANGES))], r["most"])) for i, r in enumerate(stats)]
        table = F.broadcast(spark.createDataFrame(ranges, "judge STRING, j INT, top DOUBLE"))  # at most MAX_JUDGES rows
        unit = F.col("score") / F.col("top")
        vote = F.when(unit < 1 / 3, 0).when(unit < 2 / 3, 1).otherwise(2)
        self.votes = materialise(scores.join(table, "judge").groupBy("item").agg(F.collect_list(F.struct("j", vote.alias("v"))).alias("votes")), "votes")
        self.model = TripletModel(self.names, self._pair_sums())
        self.share = self.model.share
        self.table = self.model.probabilities(self.share)
        if len(self.names) >= 3 and deals:
            self._from_views(deals)

    def _pair_sums(self) -> np.ndarray:
        """Each batch of records becomes a 0/1 matrix of records by (judge, vote); its product with itself holds all pair counts."""
        n = len(self.names)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((n * K, n * K))
            for batch in batches:
                m, _ = vote_matrix(batch["votes"], n)
                total += m.T @ m
            a, b = np.nonzero(total)
            yield pd.DataFrame({"a": a, "b": b, "n": total[a, b].astype("int64")})

        rows = self.votes.select("votes").mapInPandas(sums, "a INT, b INT, n BIGINT").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((n * K, n * K))
        for a, b, count in rows:
            out[a, b] = count
        return out.reshape(n, K, n, K)

    def _log_odds(self) -> tuple[np.ndarray, np.ndarray]:
        share = np.clip(self.share, 1e-3, 1)
        return np.log(share / share.sum()), np.log(self.table).transpose(0, 2, 1).reshape(-1, K)

    def _from_views(self, deals: int) -> None:
        """The whole confusion matrix of each judge, from the moments of three views."""
        prior, odds = self._log_odds()
        n = len(self.names)
        parts = [deal(self.names, d) for d in range(deals)]
        wide = [np.repeat(p, K) for p in parts]

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            views, votes = np.zeros((deals, K, K, K)), np.zeros((deals, n * K, K, K))
            for batch in batches:
                m, _ = vote_matrix(batch["votes"], n)
                for d in range(deals):
                    view = [posterior(m * (wide[d] == g), prior, odds) for g in range(3)]
                    views[d] += np.einsum("ri,rj,rk->ijk", *view)
                    for g in range(3):
                        one, two = view[(g + 1) % 3], view[(g + 2) % 3]
                        both = (one[:, :, None] * two[:, None, :]).reshape(len(m), K * K)
                        votes[d][wide[d] == g] += (m[:, wide[d] == g].T @ both).reshape(-1, K, K)
            whole = np.concatenate([views.ravel(), votes.ravel()])
            yield pd.DataFrame({"at": np.arange(len(whole)), "s": whole})

        size = deals * K**3
        whole = np.zeros(size + deals * n * K**3)
        for at, s in self.votes.select("votes").mapInPandas(sums, "at INT, s DOUBLE").groupBy("at").agg(F.sum("s")).collect():
            whole[at] = s
        views, votes = whole[:size].reshape(deals, K, K, K), whole[size:].reshape(deals, n, K, K, K)
        found, weight, shares = np.zeros((n, K, K)), np.zeros(n), []
        for d in range(deals):
            for g in range(3):
                # The view of part g is the third; the first and second solve the judges of part g.
                solved = solve_views(np.transpose(views[d], ((g + 1) % 3, (g + 2) % 3, g)))
                if solved is None:
                    continue
                share, first, second = solved
                shares.append(share)
                left, right = np.linalg.inv(first), np.linalg.inv(second)
                for i in np.flatnonzero(parts[d] == g):
                    # sums of first x second over the records that the judge gives a vote = first diag(share * P(vote | class)) second^T
                    p = np.stack([np.diag(left @ votes[d, i, v] @ right.T) for v in range(K)], 1)  # [class, vote]
                    if p.sum(1).min() > 0:
                        found[i] += p / p.sum(1, keepdims=True)
                        weight[i] += 1
        if not shares:
            return
        self.share = np.mean(shares, 0)
        self.share /= self.share.sum()
        p = np.clip(found / np.maximum(weight, 1)[:, None, None], 0.004, 1)
        p /= p.sum(2, keepdims=True)
        trust = np.where(weight > 0, self.model.votes / (self.model.votes + FEW_VOTES), 0.0)[:, None, None]
        self.table = trust * p + (1 - trust) * self.table

    def labels(self) -> DataFrame:
        """(item, label, confidence, n_judges, agreement): agreement is the share of pairs of the record's judges that vote alike,
        corrected for chance; null for a single judge."""
        prior, odds = self._log_odds() if self.names else (np.zeros(K), np.zeros((0, K)))
        n, least = len(self.names), self.min_judges
        all_votes = self.model.marginal.T @ self.model.votes if n else np.ones(K)
        chance = float(((all_votes / all_votes.sum()) ** 2).sum())
        names = np.array(LABELS)

        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                m, count = vote_matrix(batch["votes"], n)
                p = posterior(m, prior, odds)
                per = m.reshape(len(batch), n, K).sum(1)
                with np.errstate(all="ignore"):
                    alike = (per * (per - 1)).sum(1) / (count * (count - 1))
                    agreement = np.where(count > 1, (alike - chance) / max(1 - chance, 1e-9), np.nan)
                out = pd.DataFrame({"item": batch["item"], "label": names[p.argmax(1)], "confidence": p.max(1), "n_judges": count, "agreement": pd.Series(agreement, index=batch.index).astype(object).where(count > 1, None)})
                yield out[out["n_judges"] >= least]

        kind = dict(self.votes.dtypes)["item"]
        return self.votes.mapInPandas(label, f"item {kind}, label STRING, confidence DOUBLE, n_judges INT, agreement DOUBLE")

    def judges(self) -> DataFrame:
        """(judge, votes, reliability, hit_easy, hit_medium, hit_hard): the last three are the probabilities of naming the class when it holds."""
        if not self.names:
            return self.spark.createDataFrame([], "judge STRING, votes BIGINT, reliability DOUBLE, hit_easy DOUBLE, hit_medium DOUBLE, hit_hard DOUBLE")
        p, r = self.table, reliability(self.share, self.table)
        rows = [(name, int(self.model.votes[i]), float(r[i]), *(float(p[i, k, k]) for k in range(K))) for i, name in enumerate(self.names)]
        return self.spark.createDataFrame(rows, "judge STRING, votes BIGINT, reliability DOUBLE, hit_easy DOUBLE, hit_medium DOUBLE, hit_hard DOUBLE")


def vote_matrix(votes: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix of records by (judge, vote), and the number of votes of each record."""
    m = np.zeros((len(votes), n * K))
    count = np.array([len(v) for v in votes], dtype="int32")
    if count.sum():
        row = np.repeat(np.arange(len(votes)), count)
        flat = [x["j"] * K + x["v"] for v in votes for x in v]
        m[row, flat] = 1
    return m, count


def posterior(m: np.ndarray, prior: np.ndarray, odds: np.ndarray) -> np.ndarray:
    s = prior + m @ odds
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)
