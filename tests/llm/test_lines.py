"""Line dedup and its perfect hash, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from tests.conftest import SF_SMALL
from tests.llm import brute
from txnlens.llm import lines, queries
from txnlens.llm.mph import LineIndex, PerfectHash, build_levels
from txnlens.llm.oracle import OP11

COLS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def digest(df):
    rows = df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def awkward() -> list[tuple]:
    rng = random.Random(3)
    pool = [f"line number {k} of the pool" for k in range(40)] + ["short", "", " \t", "ÄÖÜäöüßéèê", "日本語日本語日本語日", "日本語日本語日本語"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n\n"), (63, "  LINE Number 3 of the pool\r\nline number 3 of the POOL \v"), (64, "x" * 200_000)]
    docs += [(65, "x" * 200_000 + "\nÉ line with accents"), (66, "é line with accents"), (67, "É line with accents\f")]
    docs += [(None, pool[0]), (None, pool[1]), (5, pool[2] + "\n" + "held only by id five"), (5, "held only by id five")]
    return docs + docs[:3]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1.5) for d, t in rows], "doc_id long, text string, block string, shard double")


@pytest.mark.parametrize("sizes", [(16_000_000, 1 << 20), (20_000, 16)])
def test_lines_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(lines, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(lines, "SHARD_LINES", sizes[1])
    rows = awkward()
    assert digest(lines.drop_repeated_lines(frame(spark, rows))) == sorted(brute.line_dedup(rows), key=repr)


def test_lines_query_equals_its_twin(spark, duck_small):
    assert compare(spark, "op11_line_dedup", queries.op11_line_dedup, OP11, SF_SMALL, duck_small)["status"] == "ok"


def test_lines_of_an_empty_table(spark):
    assert lines.drop_repeated_lines(frame(spark, [])).count() == 0


def test_hot_id_and_hot_row_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BYTES", 1000)
    rows = [(7, "the same row again and again")] * 300 + [(k, f"a line of its own {k}") for k in range(100, 700)]
    blocks = lines.deal(frame(spark, rows), 20)
    per_block = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert max(per_block) < 3 * 900 / 20
    assert digest(lines.drop_repeated_lines(frame(spark, rows))) == sorted(brute.line_dedup(rows), key=repr)


def test_dealing_leaves_no_table_behind(spark):
    lines.deal(frame(spark, awkward()), 3).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_known_lines_of_another_corpus(spark):
    corpus = [(1, "the first known line\nthe second known line"), (2, "the second known line")]
    index = lines.line_index(frame(spark, corpus), 1)
    new = [(1, "The first known line \nnew text that stays"), (9, "new text that stays\nthe second known line\nshort"), (None, "x")]
    kept = {r.doc_id: r.text for r in lines.drop_known_lines(frame(spark, new), index, 1).collect()}
    assert kept == {1: "new text that stays", 9: "new text that stays\nshort", None: "x"}


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    fp = rng.integers(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)
    if n > 10:  # keys that differ in their fingerprint alone
        h[:10] = h[0]
    assert sorted(PerfectHash(build_levels(h, fp)).slots(h, fp).tolist()) == list(range(n))


def test_index_rejects_foreign_keys():
    rng = np.random.default_rng(1)
    h, fp = np.arange(1000, dtype=np.uint64) * np.uint64(7919), rng.integers(0, 1 << 32, 1000).astype(np.uint32)
    made = LineIndex.build(h, fp, np.where(np.arange(1000) % 3 == 0, 2, 1), np.arange(1000))
    count, first = made.probe(h, fp)
    assert (count == np.where(np.arange(1000) % 3 == 0, 2, 1)).all() and (first[count > 1] == np.arange(0, 1000, 3)).all()
    count, _ = made.probe(h + np.uint64(1), fp)
    assert not count.any()
