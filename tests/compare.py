"""Run the named queries beside their SQL texts and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def canonical(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(plain(v) for v in row) for row in zip(*columns, strict=True)]
    return names, sorted(rows, key=repr)


def same_kind(a, b) -> bool:
    """Numbers compare as numbers across integer and floating types; other types must agree."""
    return a == b


def differences(spark, con, name: str, query, sql: str, folder: str) -> str:
    """Empty text if the results agree, else what differs."""
    got_names, got = canonical(query(spark, folder).toArrow())
    want_names, want = canonical(con.sql(sql).to_arrow_table())
    if got_names != want_names:
        return f"columns: only here {sorted(set(got_names) - set(want_names))}, only SQL {sorted(set(want_names) - set(got_names))}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        return f"rows: {len(got)} here, {len(want)} in SQL; {got_names} {extra} {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        g, w = bad[0]
        cells = {n: (x, y) for n, x, y in zip(got_names, g, w, strict=True) if x != y}
        return f"{len(bad)} rows differ, first: {cells}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from cohortlane.session import local_session

    folder = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in wanted or queries:
        start = time.time()
        try:
            if name in oracles:
                result = differences(spark, con, name, queries[name], oracles[name], folder)
            else:
                result = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        ok = result == "" or result.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {result}", flush=True)
    print("failed", failed, "unknown oracle keys", sorted(set(oracles) - set(queries)))


if __name__ == "__main__":
    main()
