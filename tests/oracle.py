"""Compare registered queries with their SQL on the given tables.

``python tests/oracle.py [name-part ...]`` prints one line per query.
"""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from probity.sources.tables import TABLES  # noqa: E402

DATA = os.environ.get("PROBITY_DATA", "/root/testdata/sf0.01")


def duck(directory=DATA):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def canonical(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, decimal.Decimal):
        return canonical(float(value)) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def kind(rows, position):
    return {type(r[position]).__name__ for r in rows if r[position] is not None}


def compare(spark_frame, connection, sql):
    """A list of differences, empty when rows, names, kinds and values agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} against {sorted(names)}"]
    order = sorted(names)
    got = [tuple(r) for r in spark_frame.select(*[f"`{n}`" for n in order]).collect()]
    want = [tuple(r[names.index(n)] for n in order) for r in expected]
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} against {len(want)}")
    for i, n in enumerate(order):
        a, b = kind(got, i), kind(want, i)
        if a != b:
            problems.append(f"column {n}: {a} against {b}")
    key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
    got = sorted((tuple(canonical(v) for v in r) for r in got), key=key)
    want = sorted((tuple(canonical(v) for v in r) for r in want), key=key)
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        problems.append(f"{len(different)} rows differ, first: {order} {different[0]}")
    return problems


def main(parts):
    import __spark_entry__ as entry
    from probity.session import local_session

    spark = local_session(cpus=8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck()
    oracles = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            frame = fn(spark, DATA)
            if name in oracles:
                problems = compare(frame, connection, oracles[name])
                note = "ok" if not problems else "; ".join(problems)
            else:
                problems, note = [], f"rows only: {frame.count()}"
        except Exception as error:  # noqa: BLE001
            problems, note = [error], f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problems)
        print(f"{'FAIL' if problems else 'pass'} {name} {time.time() - start:.1f}s {note[:900]}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
