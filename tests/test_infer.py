"""Inferred CSV types against pandas, and the quarantine of malformed rows."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import types as T

from txnlens.sources import infer

KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
COLUMNS = {
    "whole": ["1", "-2", "+3", "0"], "whole_missing": ["1", "", "3", "NA"], "number": ["1.5", "2", "1e3", "-.5"],
    "inf": ["1", "inf", "-inf", "2.0"], "flag": ["True", "false", "TRUE", "False"], "flag_missing": ["True", "", "False", "True"],
    "text": ["a", "1", "", "2020-01-01"], "empty": ["", "NaN", "null", ""], "big": ["9" * 25, "1", "2", "3"], "mixed": ["1", "True", "2", "x"],
}


def test_types_equal_pandas(spark, tmp_path):
    pd.DataFrame(COLUMNS).to_csv(tmp_path / "a.csv", index=False)
    want = {c: KINDS[str(t)] for c, t in pd.read_csv(tmp_path / "a.csv").dtypes.items()}
    want["big"] = "double"  # beyond 64 bits pandas keeps Python integers
    got = infer.read_csv(spark, str(tmp_path / "a.csv"))
    assert {r["column"]: r["type"] for r in got.types.collect()} == want
    missing = {r["column"]: r["n_missing"] for r in got.types.collect()}
    assert missing["whole_missing"] == 2 and missing["empty"] == 4 and missing["whole"] == 0
    rows = got.rows.collect()
    assert [r.whole for r in rows] == [1, -2, 3, 0] and [r.flag for r in rows] == [True, False, True, False]
    assert [r.number for r in rows] == [1.5, 2.0, 1000.0, -0.5] and rows[1].whole_missing is None and got.bad.count() == 0
    assert got.rows.schema == got.schema


def test_malformed_rows_are_listed_with_their_reason(spark, tmp_path):
    lines = ["a,b,c", "1,2.5,x", "2,3.5", "3,4.5,y,z", "4,oops,y", '5,6.5,"q,r"', "6,7.5,"]
    (tmp_path / "b.csv").write_text("\n".join(lines) + "\n")
    strict = infer.read_csv(spark, str(tmp_path / "b.csv"))
    assert sorted(r.record for r in strict.bad.collect()) == ["2,3.5", "3,4.5,y,z"]
    assert {r["column"]: r["type"] for r in strict.types.collect()} == {"a": "bigint", "b": "string", "c": "string"}
    loose = infer.read_csv(spark, str(tmp_path / "b.csv"), tolerance=0.3)
    assert sorted((r.record, r.reason) for r in loose.bad.collect()) == [
        ("2,3.5", "wrong number of fields"), ("3,4.5,y,z", "wrong number of fields"), ("4,oops,y", "b is no double: oops")
    ]
    assert sorted(map(tuple, loose.rows.collect())) == [(1, 2.5, "x"), (5, 6.5, "q,r"), (6, 7.5, None)]


@pytest.mark.parametrize("kind", [T.LongType(), T.DoubleType()])
def test_a_given_schema_judges_every_value(spark, tmp_path, kind):
    (tmp_path / "c.csv").write_text("a\n1\n2.5\nx\n")
    got = infer.read_csv(spark, str(tmp_path / "c.csv"), schema=T.StructType([T.StructField("a", kind)]))
    assert got.bad.count() == (2 if kind == T.LongType() else 1) and got.rows.schema["a"].dataType == kind
