"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8, partitions: int = 8, **config: str):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").config(map={k.replace("_", "."): v for k, v in config.items()})
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )


def database(folder: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, (bool, int, float)):
        return (1, f"{float(v) + 0.0:.9g}")
    return (2, str(v))


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(df, db, sql: str) -> str | None:
    """What differs, or None."""
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    theirs = _table(names, answer.fetchall())
    mine = _table(df.columns, df.collect())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    wrong = {c: (t, types[c]) for c, t in df.dtypes if SPARK_TYPES.get(t, t) != types[c]}
    if wrong:
        return f"types {wrong}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    different = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(different)} rows differ, first {different[0]}, columns {mine[0]}" if different else None


def main(folder: str, *names: str) -> int:
    from catalog import ORACLES, QUERIES

    spark, db = session(), database(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, db, ORACLES[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(*(sys.argv[1:] or ["/root/testdata/sf0.01"])), 1))
