"""Run registered queries next to their SQL twins and compare rows, columns and values.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(matches, message)"""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    if len(got) != len(want):
        extra, lack = set(got) - set(want), set(want) - set(got)
        return False, f"rows {len(got)} != {len(want)}; e.g. only spark {list(extra)[:2]} only sql {list(lack)[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ; {sorted(df.columns)}: {bad[0]}"
    return True, f"{len(got)} rows"


def main(argv):
    import __spark_entry__ as entry
    from remitloom.session import local_session

    sf_dir, names = argv[0], argv[1:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, twins = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        began = time.time()
        try:
            ok, text = compare(queries[name](spark, sf_dir), con, twins[name]) if name in twins else (
                True, f"{queries[name](spark, sf_dir).count()} rows, no twin")
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - began:6.2f}s {name}: {text}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
