"""Duplicates hidden by formatting differences (problem 4).

A ledger in the shared folder keeps, for every canonical key, the number of its copies and its earliest representative. It
is bucketed by the key, in a number of buckets that doubles as the keys grow. A batch of new rows is aggregated first, and only the buckets it touches are read, full-outer-joined
with the batch, and written anew; the other buckets stay where they are. The ledger holds keys and numbers only, so it is
small beside the texts, and the earliest record's text is fetched from the rows themselves.

Defined results: a line that is null, blank, broken off, or not exactly one object with all the keys is no record. A field
that is null counts as a field in which nothing is left. Rows with a null id are counted nowhere. An empty table gives an
empty ledger; a batch added twice counts twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readq.functions.text import canonical_text
from readq.llm.memo import Memo
from readq.session import fresh_path, materialise

FIELDS = ("passage", "question", "answer", "difficulty", "source")
#: A bucket of the ledger holds so many keys, about; it is what one task joins and writes.
BUCKET_KEYS = 1_000_000
LEDGER = "key BINARY, copies BIGINT, keep_id BIGINT"


def _not_a_number(name: str):
    raise ValueError(name)


def fields_of(line: str | None, fields: tuple[str, ...] = FIELDS) -> list[str | None] | None:
    """The fields of a sound line as text, a number or a nested value by the way it is written; None if the line is no record."""
    if not line:
        return None
    try:
        record = json.loads(line.strip("\ufeff \t\r\n\f\v\u00a0"), parse_constant=_not_a_number)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict) or not all(f in record for f in fields):
        return None
    return [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in (record[f] for f in fields)]


def record_key(values: list[str | None]) -> bytes:
    """128 bits of the canonical fields in a fixed order; the unit separator keeps fields apart, as canonical text holds no controls."""
    text = "\u001f".join(canonical_text(v) if v else "" for v in values)
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def canonical_lines(df: DataFrame, id_col: str = "line_id", line_col: str = "line", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(line_id, key) of each sound line. A line met again in a task is not worked on again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo()
        for batch in batches:
            keys = []
            for line in batch.column(1).to_pylist():
                if line in known:
                    keys.append(known[line])
                    continue
                values = fields_of(line, fields)
                known[line] = key = record_key(values) if values is not None else None
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["line_id", "key"])

    rows = df.where(F.col(id_col).isNotNull() & (F.trim(line_col) != "")).select(F.col(id_col).cast("bigint").alias("line_id"), F.col(line_col).cast("string").alias("line"))
    return rows.mapInArrow(read, "line_id BIGINT, key BINARY").where("key IS NOT NULL")


def parsed_lines(df: DataFrame, keep: list[str], line_col: str = "line", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The kept columns and the fields of each sound line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fields_of(line, fields) for line in batch.column(len(keep)).to_pylist()]
            sound = batch.filter(pa.array([v is not None for v in values], pa.bool_()))
            values = [v for v in values if v is not None]
            columns = [sound.column(i) for i in range(len(keep))] + [pa.array([v[i] for v in values], pa.string()) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *fields])

    kinds = dict(df.dtypes)
    rows = df.select(*keep, F.col(line_col).cast("string").alias("__line"))
    return rows.mapInArrow(read, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{f} STRING" for f in fields]))


class CopyLedger:
    """Counts of copies by canonical key, added to batch by batch.

    Each bucket has its own current version; the driver holds only the number of the version of each bucket, one for every
    `bucket_keys` keys. When the keys outgrow the buckets these are doubled, and that batch rewrites them all. A version is
    complete before it becomes current: a failed or repeated batch leaves the old one as it was.
    """

    def __init__(self, spark: SparkSession, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.bucket_keys, self.path = spark, bucket_keys, fresh_path(spark, "ledger")
        self.buckets = 1
        self.current: dict[int, int] = {}
        self.batches = 0

    def _read(self, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(self.current.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*paths)

    def rows(self) -> DataFrame:
        """The ledger: key, copies, keep_id (the earliest representative)."""
        return self._read()

    def add(self, batch: DataFrame, key: str = "key", row_id: str = "line_id") -> None:
        """Count a batch of (key, row id); rows without either count nowhere."""
        fresh = batch.where(F.col(key).isNotNull() & F.col(row_id).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("new_copies"), F.min(row_id).alias("new_id"))
        fresh = materialise(fresh, "batch")
        most, buckets = self._read().count() + fresh.count(), self.buckets
        while most > buckets * self.bucket_keys:
            buckets *= 2
        of_key = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
        touched = {r[0] for r in fresh.select(of_key).distinct().collect()}  # at most `buckets` numbers
        self.batches += 1
        target = f"{self.path}/version={self.batches}"
        old = self._read(touched if buckets == self.buckets else None)
        merged = old.join(fresh, "key", "full_outer").select(
            "key",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("new_copies", F.lit(0))).alias("copies"),
            F.least("keep_id", "new_id").alias("keep_id"),
            of_key,
        )
        merged.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(target)
        if buckets != self.buckets:
            self.buckets, self.current = buckets, {}
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(target)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith("bucket="):
                self.current[int(name[7:])] = self.batches


def duplicate_lines(keys: DataFrame, ledger: CopyLedger, hot: int = 10_000) -> DataFrame:
    """(keep_id, dup_id): each line of (line_id, key) whose key an earlier line has. Keys that hold a `hot`-th of all copies or more, at most
    `hot` of them, are broadcast, so that their lines stay where they are; the others are joined by key."""
    several = ledger.rows().where("copies > 1")
    total = several.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") >= max(2, -(-total // hot))
    hot_keys = F.broadcast(several.where(often).select("key", F.col("keep_id").alias("hot_id")))
    lines = keys.join(hot_keys, "key", "left")
    rest = lines.where("hot_id IS NULL").join(several.where(~often), "key")
    every = lines.where("hot_id IS NOT NULL").select(F.col("hot_id").alias("keep_id"), "line_id").unionByName(rest.select("keep_id", "line_id"))
    return every.where("line_id <> keep_id").select("keep_id", F.col("line_id").alias("dup_id"))
