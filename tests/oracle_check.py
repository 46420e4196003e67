"""Compare registered queries with their DuckDB statements: python tests/oracle_check.py sf0.01 [name ...]"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _order(row):
    return [(v is not None, str(type(v)), v) if not isinstance(v, float) else (True, "f", round(v, 4)) for v in row]


def differences(spark_df, con, sql):
    """A list of what differs; empty when rows, names, types and values agree."""
    rows = spark_df.collect()
    result = con.execute(sql)
    other_types = {d[0]: str(d[1]) for d in result.description}
    other = result.fetchall()
    found = []
    names = sorted(spark_df.columns)
    if names != sorted(other_types):
        return [f"columns {names} / {sorted(other_types)}"]
    for field in spark_df.schema:
        kind = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != other_types[field.name]:
            found.append(f"type of {field.name}: {kind} / {other_types[field.name]}")
    if len(rows) != len(other):
        return [*found, f"rows {len(rows)} / {len(other)}"]
    order = {name: k for k, name in enumerate(other_types)}
    mine = sorted(([_plain(r[n]) for n in names] for r in rows), key=_order)
    theirs = sorted(([_plain(r[order[n]]) for n in names] for r in other), key=_order)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[0]}")
    return found


def main():
    from driftway.plans.oracle import ORACLE
    from driftway.plans.queries import QUERIES
    from driftway.session import build_session

    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        if name not in ORACLE:
            print(f"{name:32s} no statement")
            continue
        start = time.time()
        try:
            found = differences(QUERIES[name](spark, folder), con, ORACLE[name])
        except Exception as error:  # report and go on with the others
            found = [str(error)[:400]]
        bad += bool(found)
        print(f"{name:32s} {time.time() - start:6.1f}s {'ok' if not found else found}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
