"""Runs registered queries and their SQL side by side: python tests/oracle_check.py [folder] [name...]"""

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def database(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(normal(r[i]) for i in order) for r in rows)
    return sorted(columns), len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    ours = digest(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", ours, None
    cur = con.execute(sql)
    theirs = digest([d[0] for d in cur.description], cur.fetchall())
    return ("ok" if ours[:3] == theirs[:3] else "MISMATCH"), ours, theirs


def main(args):
    import __spark_entry__ as entry
    from tests.session import local_session

    folder = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        folder, args = args[0], args[1:]
    spark, con = local_session(), database(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if args and not any(name == a or name.startswith(a) for a in args):
            continue
        begin = time.time()
        try:
            status, ours, theirs = compare(spark, con, folder, query, oracles.get(name))
        except Exception as error:
            status, ours, theirs = f"ERROR {type(error).__name__}: {str(error)[:1500]}", None, None
        bad += status not in ("ok", "rows-only")
        print(f"{name:45s} {status} rows={ours[1] if ours else None} {time.time() - begin:.1f}s", flush=True)
        if status == "MISMATCH":
            print("   ours  ", ours[0], ours[1], [x for x in ours[3] if x not in set(theirs[3])][:4])
            print("   theirs", theirs[0], theirs[1], [x for x in theirs[3] if x not in set(ours[3])][:4])
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
