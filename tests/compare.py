"""Run registered queries against their SQL: python -m tests.compare SF_DIR [name ...]"""

import sys
import time

import __spark_entry__ as entry
from hushgate import build_session
from tests.oracle_check import connect, difference


def main(sf: str, names: list[str]) -> None:
    spark = build_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - start
            diff = difference(got, con.execute(sql[name]).df()) if name in sql else None
        except Exception as exc:  # noqa: BLE001 - report and go on
            got, took, diff = [], time.time() - start, f"{type(exc).__name__}: {str(exc)[:700]}"
        kind = "ok" if name in sql else "rows only"
        print(f"{name:28s} {len(got):7d} {took:6.2f}s {'FAIL ' + diff if diff else kind}", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
