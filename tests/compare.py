"""Rows of a Spark query against those of its DuckDB counterpart."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def both(spark, sf_dir: str, query, sql: str) -> tuple[list, list]:
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = [tuple(plain(x) for x in row) for row in frame.select(*columns).collect()]
    result = db.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    return sorted(ours, key=repr), sorted(theirs, key=repr)
