"""Compare a query's rows with those of its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if path.is_file() else str(path) + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def difference(df, con, sql):
    """A description of how the two differ; empty if they do not."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    b = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    a = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if a == b:
        kinds = {d[0]: str(d[1]) for d in want.description}
        return f"types {dict(df.dtypes)} and {kinds}" if any(_kind(k) != _duck(kinds[c]) for c, k in df.dtypes) else ""
    return f"{order}: {sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"


def _kind(k):
    return {"bigint": "long", "int": "int", "double": "double", "string": "string", "boolean": "bool"}.get(k, k)


def _duck(k):
    k = k.upper()
    return {"BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "STRING": "string", "NUMBER": "long", "BOOLEAN": "bool", "BOOL": "bool"}.get(k, k)
