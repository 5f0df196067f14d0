"""Compare a query with its SQL twin: columns, their types, all rows and, where the SQL sorts, their order."""

import re
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

# fixed values: the same types by their two names
SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def connect(sf_dir, files=""):
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_first_on_asc_last_on_desc'")  # as Spark sorts
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{files}'")
    return con


def _value(v):
    return str(v) if isinstance(v, Decimal) else v


def ordered(columns, rows):
    """Rows as tuples with the columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_value(row[i]) for i in order) for row in rows]


def _spark_type(name):
    return name.lower() if name.startswith("DECIMAL") else SPARK_TYPES[name]


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    types = {d[0]: _spark_type(str(d[1])) for d in cur.description}
    assert {k: v.split(" ")[0] for k, v in df.dtypes} == types
    mine, theirs = ordered(df.columns, df.collect()), ordered(names, cur.fetchall())
    a, b = Counter(mine), Counter(theirs)
    assert a == b, (
        f"{len(mine)} rows against {len(theirs)}; "
        f"only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
    )
    if re.search(r"ORDER BY [\w, ]+$", sql.strip()):
        assert mine == theirs, "same rows in another order"
    return len(mine)
