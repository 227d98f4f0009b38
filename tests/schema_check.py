"""Compare Spark result types with DuckDB result types for every query (python -m tests.schema_check)."""

from __future__ import annotations

import sys

from tests.compare import duck

SPARK_TO_DUCK = {
    "double": "DOUBLE", "float": "FLOAT", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "date": "DATE",
}


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from txnlens.session import local_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(4)
    con = duck(sf)
    bad = 0
    for name, sql in oracle_sql().items():
        sdf = queries()[name](spark, sf)
        st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
        rel = con.sql(sql)
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diffs = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diffs:
            bad += 1
            print(name, diffs, flush=True)
    print(f"{bad} queries with type differences")


if __name__ == "__main__":
    main(sys.argv)
