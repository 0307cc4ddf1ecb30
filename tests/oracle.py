"""Run registered queries on Spark and their SQL on DuckDB, and compare.

Usage: python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """Comparable form of one cell."""
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def kind(name: str) -> str:
    """Coarse type class shared by both engines."""
    name = name.lower()
    for classes, label in (
        (("bigint", "hugeint", "int", "integer", "smallint", "tinyint", "long"), "int"),
        (("double", "float"), "double"),
        (("varchar", "string"), "string"),
        (("boolean",), "boolean"),
        (("date",), "date"),
    ):
        if name in classes:
            return label
    return name


def compare(spark, duck, folder, function, sql):
    frame = function(spark, folder)
    names = sorted(frame.columns)
    rows = [tuple(r[c] for c in names) for r in frame.collect()]
    if sql is None:
        return f"rows only ({len(rows)})", len(rows) > 0
    relation = duck.sql(sql)
    theirs = dict(zip(relation.columns, relation.types))
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}", False
    mine = dict(frame.dtypes)
    off = {c: (mine[c], str(theirs[c])) for c in names if kind(mine[c]) != kind(str(theirs[c]))}
    order = [relation.columns.index(c) for c in names]
    other = [tuple(r[i] for i in order) for r in relation.fetchall()]
    a = sorted((str([plain(v) for v in r]) for r in rows))
    b = sorted((str([plain(v) for v in r]) for r in other))
    note = f" types {off}" if off else ""
    if a == b:
        return f"ok ({len(a)} rows){note}", not off
    first = next(((x, y) for x, y in zip(a, b) if x != y), (a[len(b):][:1], b[len(a):][:1]))
    bad = sum(x != y for x, y in zip(a, b))
    return f"MISMATCH {len(a)} vs {len(b)} rows, {bad} differ{note}\n    spark {first[0]}\n    duck  {first[1]}", False


def connect(folder):
    import duckdb

    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return duck


def main():
    from hearthline.bindings import catalog
    from hearthline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, duck = local_session("oracle"), connect(folder)
    failed = []
    for name, (function, sql) in catalog().items():
        if chosen and not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for c in chosen):
            continue
        start = time.time()
        try:
            text, good = compare(spark, duck, folder, function, sql)
        except Exception as problem:  # noqa: BLE001
            text, good = "ERROR " + "".join(traceback.format_exception_only(problem))[:1500], False
        if not good:
            failed.append(name)
        print(f"{name}: {text} [{time.time() - start:.1f}s]", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main()
