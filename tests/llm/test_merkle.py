"""The Merkle manifest against a plain version, its twin, and tampering of every field."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from tests.conftest import SF_SMALL
from tests.llm import brute
from txnlens.llm import merkle, queries
from txnlens.llm.oracle import OP12

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash int, pos string"
COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "p") for r in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def documents(n: int, sources: int) -> list[tuple]:
    """A third of the rows has one source; the others are spread."""
    rng = random.Random(n)
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(sources)}"
        rows.append((k * 7 % 1009 + k, source, rng.choice(["de", None, ""]), rng.choice([None, k]), f"Text {k} ÄÖ"))
    return rows


AWKWARD = [
    (None, None, None, None, None), (None, None, None, None, None), (1, None, "", 0, ""), (2, "", "x", -1, "A" * 100_000),
    (3, "é", "x", 1, "É"), (3, "é", "x", 1, "É"), (3, "é", "x", 1, "other"), (4, "z", "x", 1, "lone"), (10, "~", "y", 2, "UPPER"),
]


@pytest.mark.parametrize(("n", "levels"), [(1, 3), (16, 1), (17, 1), (300, 1), (300, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, levels):
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 50)
    rows = documents(n, 5) + (AWKWARD if n == 300 else [])
    assert rows_of(queries.merkle_check(frame(spark, rows))) == sorted(brute.merkle(rows), key=repr)


def test_several_rounds_with_a_ragged_last_subtree(spark, monkeypatch):
    """One leaf a chunk: the butterfly does all the work, over three rounds and incomplete groups."""
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", 0)
    rows = [(k, "only", "x", k, f"t{k}") for k in range(16 * 16 + 37)] + [(k, "two", "x", k, f"u{k}") for k in range(2)]
    assert rows_of(queries.merkle_check(frame(spark, rows))) == sorted(brute.merkle(rows), key=repr)


def test_many_small_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", 1)
    rows = [(k, f"s{k:04}", "x", k, f"t{k}") for k in range(400)]
    assert rows_of(queries.merkle_check(frame(spark, rows))) == sorted(brute.merkle(rows), key=repr)


def test_query_equals_its_twin(spark, duck_small):
    assert compare(spark, "op12_merkle", queries.op12_merkle, OP12, SF_SMALL, duck_small)["status"] == "ok"


def test_empty_table(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_proofs_are_whole_and_any_change_shows(spark):
    rows = documents(60, 3)
    made = merkle.manifest(frame(spark, rows).withColumn("kept", F.col("n_chars")), carry=["kept"])
    got = made.select("*", merkle.fold(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert all(r.f == r.root for r in got) and len({r.root for r in got}) == 1
    assert {r.doc_id: r.carried.kept for r in got} == {r[0]: r[3] for r in rows}
    changed = [(*rows[0][:3], 9, rows[0][4])] + rows[1:]
    assert merkle.manifest(frame(spark, changed)).first().root != got[0].root
