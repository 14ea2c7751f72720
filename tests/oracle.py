"""Compare a Spark query with its DuckDB SQL: same columns, same multiset of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if isinstance(value, (bool, int, str, type(None))):
        return value
    return str(value)


# How each Spark column type must come back from the SQL side.
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT",
}


def type_differences(spark_df, con, sql: str) -> list[str]:
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} is {sql_types.get(name)} in SQL"
        for name, kind in spark_df.dtypes
        if SQL_TYPES.get(kind) != sql_types.get(name)
    ]


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both agree."""
    wrong = type_differences(spark_df, con, sql)
    if wrong:
        return wrong
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    got = spark_df.collect()
    cols = spark_df.columns
    if sorted(cols) != sorted(names):
        return [f"columns {sorted(cols)} != {sorted(names)}"]
    order = sorted(cols)
    gi = [cols.index(c) for c in order]
    wi = [names.index(c) for c in order]
    have = Counter(tuple(_cell(r[i]) for i in gi) for r in got)
    want = Counter(tuple(_cell(r[i]) for i in wi) for r in want_rows)
    if have == want:
        return []
    extra, missing = have - want, want - have
    return [
        f"rows {sum(have.values())} vs {sum(want.values())}; columns {order}",
        f"only spark: {list(extra)[:3]}",
        f"only sql:   {list(missing)[:3]}",
    ]
