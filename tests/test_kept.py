"""The filter cube, incremental refresh and mergeable sketches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import cube as CU
from txnlens.operators import rates as R
from txnlens.operators import sketches as SK
from txnlens.plans.refresh import KeptStage

VIEW = "Day_label string, Hour int, Class int, Amount double"


def view_rows(n, seed):
    rng = random.Random(seed)
    amounts = [0.0, 0.0, 10.0, 37.5, 99.99, 500.0, None]
    return [
        (rng.choice(["Day 1", "Day 2", None]), rng.randrange(24), int(rng.random() < 0.2),
         rng.choice(amounts) if k % 3 else round(rng.expovariate(0.02), 2))
        for k in range(n)
    ]


def cards(df):
    return {r.metric: None if r.value is None else round(r.value, 6) for r in df.collect()}


FILTERS = [
    R.TxnFilter(), R.TxnFilter(max_amount=37.5), R.TxnFilter(days=("Day 2",), hours=(3, 9), max_amount=12.345),
    R.TxnFilter(max_amount=0.0), R.TxnFilter(max_amount=-1.0), R.TxnFilter(max_amount=1e9), R.TxnFilter(days=("Day 9",)),
]


@pytest.fixture(scope="module")
def cube(spark):
    view = spark.createDataFrame(view_rows(800, 1), VIEW)
    return view, CU.build_cube(view, cells=16)


@pytest.mark.parametrize("i", range(len(FILTERS)))
def test_cube_scorecard_equals_the_scan(cube, i):
    view, made = cube
    assert cards(CU.cube_scorecard(made, FILTERS[i])) == cards(R.scorecard(FILTERS[i].apply(view), peak_from=view))


def test_cube_reads_boundary_rows_only(cube):
    _, made = cube
    plan = CU.boundary_rows(made, FILTERS[2])._jdf.queryExecution().executedPlan().toString()
    assert f"{CU.CELL}" in plan.split("PartitionFilters")[1].split("]")[0] and "LessThanOrEqual(Amount,12.345)" in plan
    read = CU.boundary_rows(made, FILTERS[2]).select("_metadata.file_path").distinct().collect()
    assert {r[0].split(f"{CU.CELL}=")[1].split("/")[0] for r in read} <= {str(made.cell(12.345))}


def test_cubes_of_appended_rows_merge(spark, cube):
    view, made = cube
    more = spark.createDataFrame(view_rows(150, 2), VIEW)
    both = CU.merge_cubes([made, CU.build_cube(more, edges=made.edges)])
    whole = view.unionByName(more)
    for f in FILTERS[:4]:
        assert cards(CU.cube_scorecard(both, f)) == cards(R.scorecard(f.apply(whole), peak_from=whole))
    with pytest.raises(ValueError, match="edges"):
        CU.merge_cubes([made, CU.build_cube(more, cells=4)])


def kept(spark, tmp_path, calls):
    def transform(df):
        calls.append(sorted(f.rsplit("/", 1)[1] for f in df.inputFiles()))
        return df.withColumn("twice", F.col("v") * 2)

    return KeptStage(
        spark, str(tmp_path / "in"), f"t-{tmp_path.name}", transform,
        lambda t: t.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("twice").alias("s")),
        lambda p: p.groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s")),
    )


def write(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "g int, v long").coalesce(1).toPandas().to_parquet(tmp_path / "in" / name)


def test_refresh_reads_appended_files_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls: list = []
    stage = kept(spark, tmp_path, calls)
    write(spark, tmp_path, "a.parquet", [(1, 1), (2, 2)])
    write(spark, tmp_path, "b.parquet", [(1, 5)])
    assert len(stage.refresh()) == 2 and stage.refresh() == []
    write(spark, tmp_path, "c.parquet", [(2, 7), (3, 1)])
    assert [p.rsplit("/", 1)[1] for p in stage.refresh()] == ["c.parquet"]
    assert calls == [["a.parquet", "b.parquet"], ["c.parquet"]]
    assert sorted(map(tuple, stage.result().collect())) == [(1, 2, 12), (2, 2, 18), (3, 1, 2)]
    assert sorted(r.twice for r in stage.rows().collect()) == [2, 2, 4, 10, 14]


def test_refresh_starts_over_when_a_file_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stage = kept(spark, tmp_path, [])
    write(spark, tmp_path, "a.parquet", [(1, 1)])
    write(spark, tmp_path, "b.parquet", [(1, 1)])
    stage.refresh()
    write(spark, tmp_path, "a.parquet", [(1, 100), (1, 100), (2, 3)])
    assert len(stage.refresh()) == 2
    assert sorted(map(tuple, stage.result().collect())) == [(1, 3, 402), (2, 1, 6)]


def test_a_failed_refresh_does_not_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stage = kept(spark, tmp_path, [])
    write(spark, tmp_path, "a.parquet", [(1, 1)])
    stage.refresh()
    write(spark, tmp_path, "b.parquet", [(2, 2)])
    good, stage.partial = stage.partial, lambda t: 1 / 0
    with pytest.raises(ZeroDivisionError):
        stage.refresh()
    assert sorted(map(tuple, stage.result().collect())) == [(1, 1, 2)]
    stage.partial = good
    stage.refresh()
    assert sorted(map(tuple, stage.result().collect())) == [(1, 1, 2), (2, 1, 4)]


def test_sketches_merge_within_their_rank_error(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.lognormal(3, 2, 30_000), np.full(15_000, 1.0)])
    rows = spark.createDataFrame([(i % 37, float(x), float(-x)) for i, x in enumerate(v)], "part int, a double, b double")
    k = 256
    merged = SK.merge_sketches(SK.sketch_columns(rows, ["a", "b"], ["part"], k), k=k)
    probs = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    got = {r["column"]: r for r in SK.sketch_quantiles(merged, probs, [f"p{i}" for i in range(len(probs))]).collect()}
    for c, data in (("a", np.sort(v)), ("b", np.sort(-v))):
        for i, p in enumerate(probs):
            x = got[c][f"p{i}"]
            below, upto = np.searchsorted(data, x, "left") / len(v), np.searchsorted(data, x, "right") / len(v)
            assert below - 2 * SK.rank_error(k) <= p <= upto + 2 * SK.rank_error(k)
    d = {r["column"]: r for r in SK.describe_sketched(merged).collect()}["a"]
    assert d["count"] == len(v) and d["mean"] == pytest.approx(v.mean()) and d["std"] == pytest.approx(v.std(ddof=1))
    assert (d["min"], d["max"]) == (v.min(), v.max())
