"""Run registered queries next to their SQL statements: ``python tests/compare.py DIR [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(got, df.columns), _rows(want, names)
    if a == b:
        return None
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} rows != {len(b)} rows; columns {sorted(names)}; first {str(first)[:1500]}"


def main() -> None:
    from tests.conftest import make_session
    from tomeworks.operators.settle import release
    import __spark_entry__ as e

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    queries, statements = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in statements:
                found = difference(df, con, statements[name])
                note = found or f"equal ({con.execute('SELECT count(*) FROM (' + statements[name] + ')').fetchone()[0]} rows)"
            else:
                found, note = None, f"{len(df.collect())} rows, no statement"
        except Exception as exc:  # show and go on
            found = note = f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += found is not None
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
