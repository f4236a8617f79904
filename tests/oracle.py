"""Side-by-side comparison with DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(directory):
        path = f"{directory}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(frame) -> Counter:
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    columns = sorted(frame.columns)
    return Counter(str([plain(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())
