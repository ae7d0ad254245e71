"""Run a query and its SQL and compare the rows, whatever their order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "qde", "qde_lines", "qg_dataset", "triples", "word_freq", "graded_passages", "mix_targets", "split_shares", "bin_sizes")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in df.collect())


def differences(query, sql: str, spark, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    mine, theirs = spark_rows(query(spark, sf_dir)), sql_rows(sql, sf_dir)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    left, right = mine[1] - theirs[1], theirs[1] - mine[1]
    return "" if not left and not right else f"{sum(left.values())} rows only here, {sum(right.values())} only there; {list(left)[:2]} {list(right)[:2]}"
