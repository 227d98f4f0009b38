"""Preparation for modelling (RS-1..6): exact stratified split, scaling, class weights, SMOTE.

Randomness is always derived from hashes of row keys and a seed, never from
``rand()``, so every task retry and every re-run produces the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.clean import apply_standard, standard_params
from txnlens.plans.ordered import prefix_rank
from txnlens.plans.small import fits, join_small
from txnlens.plans.stage import write_table
from txnlens.spec import TxnSpec


CUT_BUCKET_ROWS = 100_000


def row_hash(df: DataFrame, seed: int = 42, key: str | None = None) -> Column:
    """Seeded md5 hex of the key (or of the whole row when there is no key)."""
    if key:
        src = F.col(key).cast("string")
    else:
        src = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return F.md5(F.concat(src, F.lit(f"#{seed}")))


def _hash_buckets(df: DataFrame, key: str | None, seed: int, bucket_digits: int | None) -> DataFrame:
    """``df`` with a seeded hash ``_h`` and its prefix ``_b``, an ordered bucket of about CUT_BUCKET_ROWS rows."""
    if bucket_digits is None:
        n = df.count()
        bucket_digits = next(d for d in range(1, 14) if n <= CUT_BUCKET_ROWS * 16**d)
    x = df.withColumn("_h", row_hash(df, seed, key))
    return x.withColumn("_b", F.conv(F.substring("_h", 1, bucket_digits), 16, 10).cast("long"))


def _cut_buckets(x: DataFrame, lbl: str, test_frac: float) -> DataFrame:
    """Per (label, bucket): rows, rows before it, and the label's number of test rows."""
    cnt = x.groupBy(lbl, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wl = Window.partitionBy(lbl)
    frac = F.lit(Decimal(str(test_frac)))
    return cnt.select(
        lbl,
        "_b",
        "_c",
        F.coalesce(F.sum("_c").over(wl.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.ceil(F.sum("_c").over(wl) * frac).cast("long").alias("_ntest"),
    )


def split_cuts(
    df: DataFrame,
    spec: TxnSpec = TxnSpec(),
    test_frac: float = 0.2,
    seed: int = 42,
    bucket_digits: int | None = None,
) -> DataFrame:
    """One row per label: hash and key of its last test row, as :func:`assign_split` takes them.

    Reads label and key only. Rows are ordered by the seeded hash of the key;
    bucket counts tell the one bucket a label is cut in, and only that bucket's
    rows are ranked. ``spec.key`` must be unique: a key that the cut would have
    to part raises.
    """
    lbl = spec.label
    x = _hash_buckets(df.select(lbl, spec.key), spec.key, seed, bucket_digits)
    offs = _cut_buckets(x, lbl, test_frac)
    cut = offs.where((F.col("_off") < F.col("_ntest")) & (F.col("_off") + F.col("_c") >= F.col("_ntest")))
    rows = join_small(x, cut, [lbl, "_b"], "inner")
    rn = F.col("_off") + F.row_number().over(Window.partitionBy(lbl, "_b").orderBy("_h", spec.key))
    at = F.struct(F.col("_h").alias("h"), F.col(spec.key).cast("string").alias("k"))
    ends = rows.withColumn("_rn", rn).groupBy(lbl).agg(
        F.max(F.when(F.col("_rn") == F.col("_ntest"), at)).alias("last"),
        F.max(F.when(F.col("_rn") == F.col("_ntest") + 1, at)).alias("next"),
    )
    clear = F.col("next").isNull() | (F.col("last") != F.col("next"))
    return ends.select(
        lbl,
        F.when(clear, F.col("last.h")).otherwise(F.raise_error(F.lit("the key is not unique"))).alias("cut_hash"),
        F.col("last.k").alias("cut_key"),
    )


MAX_LABELS = 10_000


def assign_split(df: DataFrame, cuts: DataFrame, spec: TxnSpec = TxnSpec(), seed: int = 42) -> DataFrame:
    """``df`` with ``split``, by the stored ``cuts`` (one row a label, checked before it is broadcast).

    A projection: no row moves, and the wide table need not be kept for its split.
    """
    if not fits(cuts, MAX_LABELS):
        raise ValueError(f"more than {MAX_LABELS} labels: not a classification label")
    h = row_hash(df, seed, spec.key)
    x = df.join(F.broadcast(cuts), spec.label)
    key = F.col(spec.key).cast("string")
    first = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (key <= F.col("cut_key")))
    return x.withColumn("split", F.when(first, F.lit("test")).otherwise(F.lit("train"))).drop("cut_hash", "cut_key")


def stratified_split(
    df: DataFrame,
    spec: TxnSpec = TxnSpec(),
    test_frac: float = 0.2,
    seed: int = 42,
    bucket_digits: int | None = None,
) -> DataFrame:
    """Add ``split`` = 'test' | 'train'; per label exactly ceil(test_frac * n) test rows.

    Rows are ordered by a seeded hash within their label; the first rows are
    test. With a unique key, :func:`split_cuts` and :func:`assign_split` do the
    same without moving rows. Here rows may repeat: the hash prefix is a
    balanced, ordered bucket with so many hex digits that it holds about
    ``CUT_BUCKET_ROWS`` rows (or as many as ``bucket_digits`` says).
    Per-(label, bucket) counts are prefix-summed, buckets entirely before/after
    the cut are decided without any shuffle of their rows, and only the single
    cut bucket of each label is ranked by a window.
    """
    lbl = spec.label
    x = _hash_buckets(df, spec.key, seed, bucket_digits)
    # one row per label and bucket; the planner broadcasts it only below its size threshold
    x = join_small(x, _cut_buckets(x, lbl, test_frac), [lbl, "_b"], "inner")
    decided = x.where((F.col("_off") + F.col("_c") <= F.col("_ntest")) | (F.col("_off") >= F.col("_ntest")))
    decided = decided.withColumn(
        "split", F.when(F.col("_off") + F.col("_c") <= F.col("_ntest"), F.lit("test")).otherwise(F.lit("train"))
    )
    cut = x.where((F.col("_off") < F.col("_ntest")) & (F.col("_off") + F.col("_c") > F.col("_ntest")))
    rn = F.row_number().over(Window.partitionBy(lbl, "_b").orderBy("_h", *([spec.key] if spec.key else [])))
    cut = cut.withColumn(
        "split", F.when(F.col("_off") + rn <= F.col("_ntest"), F.lit("test")).otherwise(F.lit("train"))
    )
    out = decided.unionByName(cut)
    return out.drop("_h", "_b", "_c", "_off", "_ntest")


def split_report(df: DataFrame, spec: TxnSpec = TxnSpec(), split: str = "split") -> DataFrame:
    """Rows, positives and positive rate (%) per split."""
    lbl = F.col(spec.label)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lbl == 1).alias("positives"),
        (F.count_if(lbl == 1) / F.count(F.lit(1)) * 100).alias("rate_pct"),
    )


def scale_by_split(df: DataFrame, cols: Sequence[str], split: str = "split", fit_on: str = "train") -> DataFrame:
    """Standardise ``cols`` with parameters fitted on the ``fit_on`` split only."""
    params = standard_params(df.where(F.col(split) == fit_on), cols)
    return apply_standard(df, params, cols)


def class_weights(df: DataFrame, spec: TxnSpec = TxnSpec()) -> DataFrame:
    """Balanced class weights n / (k * n_c), usable as a ``weightCol``."""
    g = df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the per-label result (a few rows)
    return g.select(
        spec.label,
        "n",
        (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"),
    )


def draw(id_col: str, seed: int, digits: int) -> Column:
    """A whole number from the first ``digits`` (up to 15) hex digits of a seeded md5 of the id."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def smote(
    df: DataFrame,
    features: Sequence[str],
    spec: TxnSpec = TxnSpec(),
    k: int = 5,
    seed: int = 42,
    bucket_rows: int = 1024,
    flag: str = "synthetic",
) -> DataFrame:
    """SMOTE: raise every smaller class to the majority count with interpolated rows.

    Each synthetic row is ``x + u * (x_nn - x)`` where ``x`` is a row of the
    class chosen uniformly, ``x_nn`` one of its k exact nearest neighbours
    (:func:`txnlens.plans.neighbors.exact_knn`) chosen uniformly, and
    ``u ~ U[0, 1)``. All three draws come from a seeded md5 of the synthetic
    row's id, so the output is reproducible and independent of partitioning.
    Integer feature columns are cast back (truncated) after interpolation;
    non-feature columns (e.g. the key) are NULL on synthetic rows, which carry
    ``flag = true``.
    """
    from txnlens.plans.neighbors import exact_knn

    lbl = spec.label
    # per-class counts: a handful of rows, needed to size the generation
    counts = {r[lbl]: r["n"] for r in df.groupBy(lbl).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df.withColumn(flag, F.lit(False))
    if not counts:
        return out
    n_max = max(counts.values())
    types = dict(df.dtypes)
    feats = list(features)
    for c, m in sorted(counts.items(), key=lambda kv: str(kv[0])):
        need = n_max - m
        if need <= 0 or m < 2:
            continue
        kk = min(k, m - 1)
        # the class rows are written first, so the ranking and neighbour plans
        # start from a Parquet leaf instead of inlining the caller's lineage
        cls = write_table(df.where(F.col(lbl) == F.lit(c)), f"smote-input-{c}")
        src = F.col(spec.key) if spec.key else F.to_json(F.struct(*[F.col(f"`{x}`") for x in cls.columns]))
        # dense 0-based id in the order of a seeded md5 of the key, whatever the order of summation of the features
        ranked = prefix_rank(
            cls.withColumn("_order", F.md5(F.concat(src.cast("string"), F.lit(f"#{seed}")))), "_order", (), "_rn", None
        )
        # the class table is read ~4 times below: write it once (cuts the lineage)
        mc = write_table(ranked.withColumn("_sid", F.col("_rn") - 1).drop("_rn", "_order"), f"smote-class-{c}")
        knn = write_table(exact_knn(mc, "_sid", feats, kk, seed, bucket_rows), f"smote-knn-{c}")
        gen = mc.sparkSession.range(need).select(
            F.col("id").alias("_gid"),
            F.pmod(draw("id", seed, 15), F.lit(m)).alias("_base"),
            (F.pmod(draw("id", seed + 1, 15), F.lit(kk)) + 1).cast("int").alias("_j"),
            (draw("id", seed + 2, 13).cast("double") / float(1 << 52)).alias("_u"),
        )
        # vectors meet once a neighbour pair, not once a synthetic row, which moves only its draws;
        # the planner takes an array for one element, so it would broadcast a class of any size
        near = knn.select(F.col("_sid").alias("_base"), F.col("nn_rank").alias("_rank"), F.col("nn__sid").alias("_nb"))
        if need < kk * m:  # only the pairs that are drawn
            drawn = gen.select("_base", F.col("_j").alias("_rank")).distinct()
            near = near.join(drawn, ["_base", "_rank"], "left_semi")
        vec = F.array(*[F.col(f"`{f}`").cast("double") for f in feats])
        base = mc.select(F.col("_sid").alias("_base"), vec.alias("_x")).hint("merge")
        nbr = mc.select(F.col("_sid").alias("_nb"), vec.alias("_y")).hint("merge")
        pairs = near.join(nbr, "_nb").drop("_nb").join(base, "_base").withColumnRenamed("_base", "_sid").hint("merge")
        # the rank as a difference, so that the pairs stay where they met their base
        s = gen.join(pairs, (gen["_base"] == pairs["_sid"]) & (gen["_j"] - pairs["_rank"] == 0))
        # interpolate all features as one array expression, then split into columns
        s = s.select(F.zip_with("_x", "_y", lambda a, b: a + F.col("_u") * (b - a)).alias("_s"))
        cols = []
        for name in df.columns:
            if name in feats:
                i = feats.index(name)
                cols.append(F.element_at("_s", i + 1).cast(types[name]).alias(name))
            elif name == lbl:
                cols.append(F.lit(c).cast(types[name]).alias(name))
            else:
                cols.append(F.lit(None).cast(types[name]).alias(name))
        out = out.unionByName(s.select(*cols, F.lit(True).alias(flag)))
    return out
