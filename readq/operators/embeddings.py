"""Nearest neighbours and triplets of embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readq.functions import numeric as M
from readq.session import materialise

#: Queries of one block; a block goes to the tasks with the code, so its size bounds what an executor holds.
BLOCK_ROWS = 2_000
#: Labels that triplets are drawn from.
MAX_LABELS = 100


def _block_search(rows: DataFrame, ids: np.ndarray, asked: np.ndarray, n: int, least: float | None, probed: np.ndarray | None = None) -> DataFrame:
    """(query_id, id, similarity): the best n rows of each query that each task finds. rows: id BIGINT, v, and cell if there is probed, which
    says for each query and cell whether the query looks there. A batch is one matrix product."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), n), -np.inf)
        best_id = np.full((len(ids), n), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v = batch.column(0).to_numpy(), _matrix(batch.column(1), asked.shape[1])
            cells = batch.column(2).to_numpy() if probed is not None else np.zeros(len(own), np.int64)
            for cell in np.unique(cells):
                here = np.flatnonzero(cells == cell)
                q = np.flatnonzero(probed[:, cell]) if probed is not None else np.arange(len(ids))
                for i in range(0, len(here) if len(q) else 0, 4096):
                    part = here[i : i + 4096]
                    sims = np.round(asked[q] @ v[part].T, 6)
                    sims[ids[q][:, None] == own[part][None, :]] = -np.inf
                    sims[np.isnan(sims) | (sims < (-np.inf if least is None else least))] = -np.inf
                    both = np.concatenate([best[q], sims], 1)
                    both_id = np.concatenate([best_id[q], np.broadcast_to(own[part], sims.shape)], 1)
                    order = np.lexsort((both_id, -both), axis=1)[:, :n]
                    best[q], best_id[q] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)
        q, k = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_id[q, k]), pa.array(best[q, k])], ["query_id", "id", "similarity"])

    return rows.mapInArrow(search, "query_id BIGINT, id BIGINT, similarity DOUBLE")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as the rows of a matrix; null vectors and those of another length or without length as not-a-number."""
    out = np.full((len(column), dims), np.nan)
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    out[fit] = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(all="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def _blocks(queries: DataFrame, id_col: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries' ids and vectors, BLOCK_ROWS at a time."""
    asked = queries.where(F.col(id_col).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    for k in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else asked).collect()  # about BLOCK_ROWS rows
        if rows:
            yield np.array([r["id"] for r in rows], dtype=np.int64), _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), len(rows[0]["v"]))


def _ranked(parts: list[DataFrame], df: DataFrame, n: int) -> DataFrame:
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id BIGINT, id BIGINT, similarity DOUBLE, rank BIGINT")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "id", vector: str = "embedding", n: int = 20, least: float | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the n most similar rows of each query, itself left out, by cosine; ties by id. Exact.

    The stated queries are compared with all rows, block by block, by matrix products; each task keeps its best n of a query.
    Vectors without length have no neighbours. Ids are whole numbers; all vectors have the length of the first query's.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return _ranked([_block_search(rows, ids, asked, n, least) for ids, asked in _blocks(queries, id_col, vector)], df, n)


class VectorIndex:
    """An inverted file of vectors: cells around centres, every row in the cell of its most similar centre.

    The centres are fitted on a sample, the SAMPLE rows of lowest hash; every row is indexed. A search looks into the cells whose
    centres are most similar to the query, so it finds most but not all of the nearest; `recall` measures how many, against
    the exact search. The rows of a cell stay spread over the tasks that wrote them, so a large cell is no large task.
    """

    SAMPLE = 20_000

    def __init__(self, df: DataFrame, id_col: str = "id", vector: str = "embedding", cells: int = 64, rounds: int = 10):
        self.spark, self.id_col, self.vector = df.sparkSession, id_col, vector
        rows = df.where(F.col(id_col).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(self.SAMPLE).collect()
        dims = len(sample[0]["v"]) if sample else 1
        x = _matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), dims) if sample else np.zeros((0, dims))
        x = x[~np.isnan(x).any(1)]
        self.centres = self._fit(x, cells, rounds)
        centres = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sims = _matrix(batch.column(1), dims) @ centres.T if len(centres) else np.full((batch.num_rows, 1), np.nan)
                keep = ~np.isnan(sims).any(1)
                some = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sims[keep].argmax(1).astype(np.int32))], ["id", "v", "cell"])

        self.rows = materialise(rows.mapInArrow(assign, "id BIGINT, v ARRAY<DOUBLE>, cell INT"), "index", ["cell"]).select("id", "v", "cell")

    @staticmethod
    def _fit(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
        """Spherical k-means from evenly chosen rows of the sample."""
        if not len(x):
            return x
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, own, x)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(length > 0, total / np.maximum(length, 1e-12), centres)
        return centres

    def search(self, queries: DataFrame, n: int = 20, probes: int = 16) -> DataFrame:
        """(query_id, id, similarity, rank) as `nearest`, out of the `probes` cells most similar to each query."""
        parts = []
        for ids, asked in _blocks(queries, self.id_col, self.vector) if len(self.centres) else []:
            near = np.argsort(-np.nan_to_num(asked @ self.centres.T, nan=-2.0), axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(ids), len(self.centres)), dtype=bool)
            np.put_along_axis(probed, near, True, 1)
            rows = self.rows.where(F.col("cell").isin(np.flatnonzero(probed.any(0)).tolist()))
            parts.append(_block_search(rows, ids, asked, n, None, probed))
        return _ranked(parts, self.rows, n)

    def recall(self, df: DataFrame, queries: DataFrame, n: int = 20, probes: int = 16) -> float:
        """The share of the exact nearest rows that the search finds."""
        return self._share(nearest(df, queries, self.id_col, self.vector, n).select("query_id", "id"), queries, n, probes)

    def _share(self, exact: DataFrame, queries: DataFrame, n: int, probes: int) -> float:
        found = self.search(queries, n, probes).select("query_id", "id")
        return exact.join(found, ["query_id", "id"]).count() / max(1, exact.count())

    def probes_for(self, df: DataFrame, n: int = 20, least: float = 0.9, measured: int = 200) -> int:
        """So many cells that the recall is at least so high, measured on the `measured` rows of lowest hash against the exact search."""
        queries = df.where(F.size(self.vector) > 0).orderBy(F.xxhash64(F.lit(1), self.id_col)).limit(measured)
        queries = materialise(queries, "queries")
        exact = materialise(nearest(df, queries, self.id_col, self.vector, n).select("query_id", "id"), "exact")
        probes = 4
        while probes < len(self.centres) and self._share(exact, queries, n, probes) < least:
            probes = -(-probes * 3 // 2)
        return min(probes, max(1, len(self.centres)))


def triplets(df: DataFrame, id_col: str = "id", label: str = "label", mode: str = "same_class", seed: int = 42) -> DataFrame:
    """(anchor, positive, negative): for each row a positive of its own label and a negative of another.

    Rows of a label are numbered in a seeded order; the positive is the next one in the order (the first after the last), the
    negative the one with the anchor's number, modulo the size, in the label chosen. mode ordinal: positives come from the
    neighbouring label MEDIUM and negatives from the far one, for EASY and HARD. mode mixed: a hash of the anchor chooses one of
    the two modes, each for half. A label with one row has itself as positive.
    The sizes of the labels are few rows; the numbering is spread over slices of the hash.
    """
    from readq.operators.ordered import prefix_sum

    if mode not in ("same_class", "ordinal", "mixed"):
        raise ValueError(f"unknown mode {mode}")
    drawn = df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("h"))
    counts = drawn.groupBy("label").agg(F.count("*").alias("size")).where("size > 0")
    placed = prefix_sum(drawn, [F.col("label"), F.col("h"), F.col("id")], F.lit(1).cast("bigint"), "at")
    starts = placed.groupBy("label").agg(F.min("at").alias("first"))
    table = counts.join(starts, "label")
    placed = placed.join(F.broadcast(starts), "label").select("id", "label", "h", (F.col("at") - F.col("first")).alias("at"))
    known = [(r["label"], r["size"]) for r in table.orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(known) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(k).cast("bigint").alias("size")) for n, k in known]) if known else F.array().cast("array<struct<label:string,size:bigint>>")
    rows = placed.withColumn("labels", labels)
    others = F.filter("labels", lambda x: x["label"] != F.col("label"))
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    pick = lambda xs: F.get(xs, F.pmod(draw("negative"), F.size(xs)).cast("int"))
    named = lambda name: F.element_at(F.filter("labels", lambda x: x["label"] == name), 1)
    own = F.element_at(F.filter("labels", lambda x: x["label"] == F.col("label")), 1)
    if mode != "same_class":
        end = F.col("label").isin("EASY", "HARD") & named("MEDIUM").isNotNull()
        if mode == "mixed":
            end &= F.pmod(draw(f"mode|{seed}"), F.lit(2)) == 0
        positive = F.when(end, named("MEDIUM")).otherwise(own)
        negative = F.when(end & (F.col("label") == "EASY"), named("HARD")).when(end, named("EASY")).otherwise(pick(others))
    else:
        positive, negative = own, pick(others)
    shift = F.when(positive["label"] == F.col("label"), 1).otherwise(0)
    rows = rows.select(F.col("id").alias("anchor"), positive["label"].alias("pl"), F.pmod(F.col("at") + shift, positive["size"]).alias("pa"), negative["label"].alias("nl"), F.pmod(F.col("at"), negative["size"]).alias("na"))
    p = placed.select(F.col("label").alias("pl"), F.col("at").alias("pa"), F.col("id").alias("positive"))
    n = placed.select(F.col("label").alias("nl"), F.col("at").alias("na"), F.col("id").alias("negative"))
    return rows.join(p, ["pl", "pa"]).join(n, ["nl", "na"]).select("anchor", "positive", "negative")


def triplet_losses(chosen: DataFrame, df: DataFrame, id_col: str = "id", vector: str = "embedding", margin: float = 0.5) -> DataFrame:
    """The triplets with their loss."""
    v = df.select(F.col(id_col).alias("k"), F.col(vector).alias("v"))
    out = chosen
    for c in ("anchor", "positive", "negative"):
        out = out.join(v.select(F.col("k").alias(c), F.col("v").alias(f"v_{c}")), c)
    return out.select("anchor", "positive", "negative", F.round(M.triplet_loss("v_anchor", "v_positive", "v_negative", margin), 6).alias("loss"))


def spread_penalty(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(penalty): minus the mean over dimensions of the standard deviation."""
    dims = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.stddev_samp("x").alias("s"))
    return dims.agg(F.round(-F.avg("s"), 6).alias("penalty"))
