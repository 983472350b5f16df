"""Run the registered queries and their SQL side by side.

    python -m checks.compare [folder] [name ...]
"""

import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from reviewloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def rows_of(columns, rows):
    """Rows as sortable tuples, columns by name, floats at twelve digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return f"{v:.12g}" if isinstance(v, float) else str(v)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def compare(spark, db, folder, name):
    """None if both agree, else what differs."""
    frame = QUERIES[name](spark, folder)
    got = rows_of(frame.columns, frame.collect())
    result = db.execute(ORACLE[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} but {want[0]}"
    ours, theirs = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    short = [[tuple(v[:60] for v in row) for row in sorted(some)[:2]] for some in (ours, theirs)]
    return f"{len(got[1])} rows but {len(want[1])}; only here {short[0]}, only there {short[1]}"


def main(folder="/root/testdata/sf0.01", *names):
    spark, db = local_session("8"), connect(folder)
    for name in names or QUERIES:
        start = time.time()
        if name in ORACLE:
            try:
                said = compare(spark, db, folder, name) or "ok"
            except Exception as error:  # report and go on with the next
                said = f"{type(error).__name__}: {error}"
        else:
            said = f"{QUERIES[name](spark, folder).count()} rows, no SQL"
        print(f"{name}: {said[:1500]} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
