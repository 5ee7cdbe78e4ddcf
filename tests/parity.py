"""Compare registered queries with their SQL counterparts: `python tests/parity.py [sf] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def path(sf_dir: str, name: str) -> str:
    """A table is one file or a folder of files."""
    at = f"{sf_dir}/{name}.parquet"
    return f"{at}/*.parquet" if os.path.isdir(at) else at


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path(sf_dir, t)}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, bool):
        return repr(value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return repr(value)


def compare(spark, con, fn, oracle: str, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(canonical(r[n]) for n in names) for r in df.collect())
    cur = con.execute(oracle)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return [f"columns differ: {names} vs {sorted(cols)}"]
    at = [cols.index(n) for n in names]
    want = sorted(tuple(canonical(r[i]) for i in at) for r in cur.fetchall())
    if len(got) != len(want):
        return [f"{len(got)} rows vs {len(want)}", f"{names}", f"{got[:2]}", f"{want[:2]}"]
    if not got:
        return ["empty"]
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        g, w = wrong[0]
        pairs = [f"{n}: {a} | {b}" for n, a, b in zip(names, g, w) if a != b]
        return [f"{len(wrong)} of {len(got)} rows differ; {names}", *pairs, str(g), str(w)]
    return []


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from touchline.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", 8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or list(queries):
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                problems = [] if n else ["empty"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:1500])
    print(f"{bad} failing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
