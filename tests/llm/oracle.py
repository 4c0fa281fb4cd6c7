"""Compare a registered query with its SQL on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb

from kinfold.llm.queries import ORACLE, QUERIES


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    result = con.sql(ORACLE[name])
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    shape = (lambda row: tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else v for v in row))
    ours = Counter(shape(r) for r in df.select(*columns).collect())
    theirs = Counter(shape(r) for r in result.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:5], list((theirs - ours).items())[:5])
    return sum(ours.values())
