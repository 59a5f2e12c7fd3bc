"""Run registered queries and compare them with their SQL: python tools/check.py [sf dir] [names…]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodeglass.session import local_session  # noqa: E402
from lodeglass.workload import ORACLE, QUERIES  # noqa: E402
from lodeglass.workload.registry import TABLES  # noqa: E402


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=repr)


def compare(spark_df, relation):
    names, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    wanted_names, wanted = canonical(relation.columns, relation.fetchall())
    if names != wanted_names:
        return f"columns {names} <> {wanted_names}"
    if len(got) != len(wanted):
        extra = [r for r in got if r not in set(wanted)][:2] if len(got) < 5000 else []
        return f"rows {len(got)} <> {len(wanted)} {repr(extra)[:600]}"
    bad = [(a, b) for a, b in zip(got, wanted) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first: {repr(bad[0])[:1200]}"
    types = dict(spark_df.dtypes)
    for name, dtype in zip(relation.columns, relation.types):
        kinds = (types[name], str(dtype).lower())
        if kinds not in SAME and not kinds[0].startswith(("array", "decimal")):
            return f"ok but type of {name}: {kinds}"
    return f"ok {len(got)}"


SAME = {
    ("bigint", "bigint"),
    ("int", "integer"),
    ("double", "double"),
    ("string", "varchar"),
    ("boolean", "boolean"),
    ("date", "date"),
    ("timestamp_ntz", "timestamp"),
}


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session("8")
    con = connect(sf_dir)
    failures = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                verdict = compare(df, con.sql(ORACLE[name]))
            else:
                verdict = f"ok (rows only) {df.count()}"
        except Exception as problem:  # report and go on
            verdict = f"{type(problem).__name__}: {str(problem)[:1500]}"
        if not verdict.startswith("ok ") or "but" in verdict:
            failures += 1
        print(f"{name:26s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{failures} failures of {len(names)}")
    return failures


if __name__ == "__main__":
    sys.exit(min(main(), 1))
