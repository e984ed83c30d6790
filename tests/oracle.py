"""Runs a query and its SQL side by side, as the driver does."""

import math
from pathlib import Path

import duckdb
import pyarrow as pa

DATA = "/root/testdata"


def database(directory: str):
    con = duckdb.connect()
    for p in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    return con


def canon(v):
    """A value as text and tuples: NaN isn't null, and 0.0 isn't -0.0."""
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return canon(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return v


def rows(table: pa.Table):
    """Rows of an Arrow table, which keeps nulls and NaN apart."""
    cols = sorted(table.column_names)
    return cols, sorted((tuple(canon(x) for x in r) for r in zip(*(table.column(c).to_pylist() for c in cols))), key=repr)


def compare(spark, name: str, size: str = "sf0.01"):
    import __spark_entry__ as e

    d = f"{DATA}/{size}"
    ours = rows(e.queries()[name](spark, d).toArrow())
    theirs = rows(database(d).execute(e.oracle_sql()[name]).to_arrow_table())
    return ours, theirs
