"""Comparison of results with SQL."""

from pathlib import Path

import pandas as pd

DATA = "/root/testdata"


def rows_of(frame):
    """Rows as sorted tuples of text, columns by name; numbers at six digits."""

    def text(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and not isinstance(v, bool) and hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def duck(sql, folder):
    import duckdb

    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c.execute(sql).df()
