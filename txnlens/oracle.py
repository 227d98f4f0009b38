"""DuckDB twins of the registered queries (independent SQL formulations).

Each string runs on the driver's pre-registered views (``events``,
``embeddings`` ...). The ``transactions`` fixture is rebuilt as a CTE with the
same definition as :mod:`txnlens.sources.fixture`; double columns are rounded
exactly as the Spark side rounds them (:data:`txnlens.queries.DIGITS`).
"""

from __future__ import annotations

from txnlens.functions.columns import BAND_DISPLAY, BAND_EDGES, BAND_NAMES
from txnlens.operators.scoring import SCORE_EPS, SCORE_TERMS
from txnlens.operators.separation import RADAR_FEATURES
from txnlens.sources.fixture import ARRIVAL_SLOTS, LATE_HOURS, LATE_MOD

V = [f"V{i}" for i in range(1, 29)]
VL = ", ".join(V)


def _feats(variant: str) -> str:
    out = []
    for i, v in enumerate(V, start=1):
        e = f"round(CAST(m.embedding[{i}] AS DOUBLE), 6)"
        if variant == "nulls" and v == "V1":
            e = f"CASE WHEN e.event_id % 101 <> 0 THEN {e} END"
        if variant == "nulls" and v == "V2":
            e = f"CASE WHEN e.event_id % 103 = 0 THEN 'NaN'::DOUBLE ELSE {e} END"
        out.append(f"{e} AS {v}")
    return ",\n         ".join(out)


def fixture(variant: str = "base") -> str:
    pos = "m.label = 0 AND e.event_type IN ('error', 'click')"
    if variant == "rare":
        pos += " AND e.event_id % 7 = 0"
    return f"""base AS (
  SELECT e.event_id AS txn_id,
         CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', e.ts) % 172800 AS DOUBLE) AS "Time",
         {_feats(variant)},
         CASE WHEN e.event_id % 97 = 0 THEN 0.0::DOUBLE ELSE round(e.value * 4, 2) END AS Amount,
         CASE WHEN {pos} THEN 1 ELSE 0 END AS "Class"
  FROM events e JOIN embeddings m ON e.event_id % (SELECT max(vec_id) + 1 FROM embeddings) = m.vec_id
),
transactions AS (
  SELECT * FROM base UNION ALL SELECT * FROM base WHERE txn_id % 263 = 0
)"""


CLEAN = """dedup AS (SELECT DISTINCT * FROM transactions),
fences AS (
  SELECT quantile_cont(Amount, 0.25) AS q1, quantile_cont(Amount, 0.75) AS q3 FROM dedup
),
tstat AS (SELECT avg("Time") AS t_mean, stddev_pop("Time") AS t_sd FROM dedup),
capped AS (
  SELECT d.*,
         CASE WHEN d.Amount = 0 THEN 1 ELSE 0 END AS is_zero_amount,
         CASE WHEN d.Amount IS NOT NULL THEN
           least(greatest(d.Amount, greatest(f.q1 - 1.5 * (f.q3 - f.q1), 0.0)), f.q3 + 1.5 * (f.q3 - f.q1))
         END AS Amount_capped,
         (d."Time" - t.t_mean) / CASE WHEN t.t_sd IS NULL OR t.t_sd = 0 THEN 1.0 ELSE t.t_sd END AS Time_scaled
  FROM dedup d, fences f, tstat t
),
cleaned AS (
  SELECT txn_id, "Time", {VL}, Amount, "Class", is_zero_amount, Amount_capped,
         ln(1 + Amount_capped) AS Amount_log, Time_scaled
  FROM capped
)""".replace("{VL}", VL)


def _band_ord(x: str) -> str:
    low, *highs = BAND_EDGES[:-1]
    cases = " ".join(f"WHEN {x} <= {e} THEN {i}" for i, e in enumerate(highs))
    return f"CASE WHEN {x} IS NULL OR {x} <= {low}::DOUBLE THEN NULL {cases} ELSE {len(highs)} END"


def _score_input(column: str, absolute: bool, table: str = "") -> str:
    return f"abs({table}{column})" if absolute else f"{table}{column}"


#: the score's normalisers and its weighted terms, from the operator's constants
SCORE_MAXIMA = ", ".join(f"max({_score_input(c, a)}) AS m{i}" for i, (c, _, a) in enumerate(SCORE_TERMS))


def _score_sql(inputs: list[str]) -> str:
    terms = " + ".join(f"{w} * {x} / (sp.m{i} + {SCORE_EPS})" for i, ((_, w, _), x) in enumerate(zip(SCORE_TERMS, inputs, strict=True)))
    return f"least(greatest({terms}, 0.0), 1.0)"


def _list(vals) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"


HOUR = 'CAST(floor(((("Time" % 86400.0) + 86400.0) % 86400.0) / 3600) AS INTEGER)'
DAY = 'CAST(floor("Time" / 86400.0) AS INTEGER)'

VIEW = f"""sp AS (SELECT {SCORE_MAXIMA} FROM cleaned),
view0 AS (
  SELECT c.*, {HOUR} AS "Hour", {DAY} AS "Day", {_band_ord('c.Amount')} AS Amount_band_ord,
         {_score_sql([_score_input(c, a) for c, _, a in SCORE_TERMS])} AS fraud_score
  FROM cleaned c, sp
),
view AS (
  SELECT *, CASE WHEN "Day" = 0 THEN 'Day 1' WHEN "Day" = 1 THEN 'Day 2' END AS Day_label,
         ({_list(BAND_DISPLAY)})[Amount_band_ord + 1] AS Amount_band
  FROM view0
)"""


def q(ctes: list[str], body: str, round_cols: dict[str, int] | None = None, variant: str = "base") -> str:
    """Assemble ``WITH fixture, ctes... body`` and round the listed double columns."""
    sql = "WITH " + ",\n".join([fixture(variant), *ctes]) + "\n" + body
    if round_cols:
        rep = ", ".join(
            f'CASE WHEN round("{c}", {d}) = 0 THEN 0.0::DOUBLE ELSE round("{c}", {d}) END AS "{c}"' for c, d in round_cols.items()
        )
        sql = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _r"
    return sql


def r6(*cols: str, d: int = 6) -> dict[str, int]:
    return {c: d for c in cols}


# ---------------------------------------------------------------- helpers for long form
def unpivot_union(cols: list[str], src: str, extra: str = "") -> str:
    parts = []
    for i, c in enumerate(cols):
        col = f'CAST("{c}" AS DOUBLE)'
        val = f"CASE WHEN isnan({col}) THEN NULL ELSE {col} END"
        parts.append(f"SELECT '{c}' AS \"column\", {i} AS col_idx, {val} AS value{extra} FROM {src}")
    return "\n  UNION ALL ".join(parts)


NUM = ["Time", *V, "Amount", "Class"]
NUM_NOLABEL = ["Time", *V, "Amount"]


def _oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["table_shape"] = q([], "SELECT count(*) AS rows, 32 AS columns FROM transactions")

    miss_cols = ["txn_id", "Time", *V, "Amount", "Class"]
    parts = []
    for c in miss_cols:
        cond = f'"{c}" IS NULL' + (f' OR isnan("{c}")' if c not in ("txn_id", "Class") else "")
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {cond}) AS missing_count, "
            f"count(*) FILTER (WHERE {cond}) * 100.0 / count(*) AS missing_pct FROM transactions"
        )
    o["missing_report"] = q(
        [], "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE missing_count > 0", r6("missing_pct"), variant="nulls"
    )

    o["duplicate_report"] = q(
        ["g AS (SELECT count(*) AS c FROM transactions GROUP BY ALL_COLS)".replace("ALL_COLS", ", ".join(['txn_id', '"Time"', *V, 'Amount', '"Class"']))],
        "SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(c) AS BIGINT) - count(*) AS duplicates, "
        "(CAST(sum(c) AS BIGINT) - count(*)) * 100.0 / sum(c) AS duplicate_pct FROM g",
        r6("duplicate_pct"),
    )

    o["label_distribution"] = q(
        [],
        'SELECT "Class", count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM transactions GROUP BY "Class"',
        r6("percent"),
    )
    o["imbalance_ratio"] = q(
        [],
        'SELECT count(*) FILTER (WHERE "Class" = 0) AS negatives, count(*) FILTER (WHERE "Class" = 1) AS positives, '
        'CAST(count(*) FILTER (WHERE "Class" = 0) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE "Class" = 1), 0) AS ratio FROM transactions',
        r6("ratio"),
    )
    o["describe_columns"] = q(
        [f"lng AS ({unpivot_union(NUM, 'transactions')})"],
        """SELECT "column", col_idx, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
       max(value) AS max, max(value) - min(value) AS range,
       CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / avg(value) * 100 END AS cv_pct
FROM lng GROUP BY "column", col_idx""",
        r6("mean", "std", "min", "q25", "q50", "q75", "max", "range", "cv_pct"),
    )
    o["describe_sketched"] = q(
        [f"lng AS ({unpivot_union(NUM, 'transactions')})"],
        """SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       max(value) AS max, true AS within_bound FROM lng GROUP BY "column\"""",
        r6("mean", "std", "min", "max"),
    )
    whole = ("txn_id", "Class")
    kinds = ", ".join(f"('{c}', '{'bigint' if c in whole else 'double'}')" for c in ["txn_id", "Time", *V, "Amount", "Class"])
    o["csv_inferred_types"] = f'SELECT c AS "column", t AS type, CAST(0 AS BIGINT) AS n_missing FROM (VALUES {kinds}) k(c, t)'
    o["csv_quarantine"] = q(
        [],
        """SELECT 'read' AS reason, count(*) AS n, sum(Amount) AS amount FROM transactions
UNION ALL SELECT 'wrong number of fields', count(*), NULL FROM transactions WHERE txn_id % 89 = 0 HAVING count(*) > 0
UNION ALL SELECT 'Amount is no double: n.k.', count(*), NULL FROM transactions WHERE txn_id % 83 = 5 HAVING count(*) > 0""",
        r6("amount"),
    )
    o["zero_amount_report"] = q(
        [],
        'SELECT count(*) FILTER (WHERE Amount = 0) AS zero_count, count(*) FILTER (WHERE Amount = 0) * 100.0 / count(*) AS zero_pct, '
        'CAST(coalesce(sum(CASE WHEN Amount = 0 THEN "Class" END), 0) AS BIGINT) AS zero_positives FROM transactions',
        r6("zero_pct"),
    )
    o["amount_profile"] = q(
        [],
        "SELECT count(Amount) AS n, avg(Amount) AS mean, quantile_cont(Amount, 0.5) AS median, stddev_samp(Amount) AS std, "
        "min(Amount) AS min, max(Amount) AS max, skewness(Amount) AS skew FROM transactions",
        r6("mean", "median", "std", "min", "max", "skew"),
    )
    o["time_profile"] = q(
        [],
        'SELECT min("Time") AS min_s, max("Time") AS max_s, min("Time") / 3600 AS min_h, max("Time") / 3600 AS max_h, '
        'max("Time") / 3600 / 24 AS span_days FROM transactions',
        r6("min_s", "max_s", "min_h", "max_h", "span_days"),
    )
    o["amount_by_label"] = q(
        [],
        'SELECT "Class", avg(Amount) AS mean, quantile_cont(Amount, 0.5) AS median, max(Amount) AS max, stddev_samp(Amount) AS std '
        'FROM transactions GROUP BY "Class"',
        r6("mean", "median", "max", "std"),
    )
    corr_cols = ["Time", *V, "Amount", "is_zero_amount", "Amount_capped", "Amount_log", "Time_scaled", "Hour", "Day"]
    o["label_correlations"] = q(
        [CLEAN, VIEW, f"lng AS ({unpivot_union(corr_cols, 'view', ', CAST(\"Class\" AS DOUBLE) AS y')})",
         'c AS (SELECT "column", col_idx, corr(value, y) AS corr FROM lng GROUP BY "column", col_idx)'],
        "SELECT *, corr < 0 AS negative FROM c",
        r6("corr"),
    )
    o["skew_before_after"] = q(
        [CLEAN], "SELECT skewness(Amount) AS skew_before, skewness(Amount_log) AS skew_after FROM cleaned", r6("skew_before", "skew_after")
    )
    o["csv_round_trip"] = q([], "SELECT * FROM transactions", r6("Time", "Amount", *V))
    o["moments_topk"] = q(
        [f"lng AS ({unpivot_union(V, 'transactions')})",
         'm AS (SELECT "column", col_idx, round_even(skewness(value), 4) AS skewness, round_even(kurtosis(value), 4) AS kurtosis '
         'FROM lng GROUP BY "column", col_idx)'],
        "SELECT * FROM m ORDER BY abs(skewness) DESC NULLS LAST, col_idx LIMIT 10",
        r6("skewness", "kurtosis"),
    )
    o["label_correlation_topk"] = q(
        [f"lng AS ({unpivot_union(NUM_NOLABEL, 'transactions', ', CAST(\"Class\" AS DOUBLE) AS lbl')})",
         'c AS (SELECT "column", col_idx, corr(value, lbl) AS corr FROM lng GROUP BY "column", col_idx)'],
        "SELECT * FROM c ORDER BY abs(corr) DESC NULLS LAST, col_idx LIMIT 10",
        r6("corr"),
    )
    o["iqr_outliers"] = q(
        [f"lng AS ({unpivot_union(['Amount', 'Time'], 'transactions')})",
         'qs AS (SELECT "column", col_idx, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM lng GROUP BY "column", col_idx)',
         "f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM qs)"],
        """SELECT f."column", f.col_idx, q1, q3, iqr, lower, upper,
       count(*) FILTER (WHERE value < lower) AS n_low, count(*) FILTER (WHERE value > upper) AS n_high,
       count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers,
       count(*) FILTER (WHERE value < lower OR value > upper) * 100.0 / n AS outlier_pct
FROM f JOIN lng USING ("column") GROUP BY f."column", f.col_idx, q1, q3, iqr, lower, upper, n""",
        r6("q1", "q3", "iqr", "lower", "upper", "outlier_pct"),
    )

    # ------------------------------------------------------------ cleaning / features
    o["clean_transactions"] = q([CLEAN], "SELECT * FROM cleaned", r6("Time", *V, "Amount", "Amount_capped", "Amount_log", "Time_scaled"))
    o["capping_report"] = q(
        [CLEAN],
        """SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
       (SELECT count(*) FROM dedup WHERE Amount < q1 - 1.5 * (q3 - q1)) AS n_low,
       (SELECT count(*) FROM dedup WHERE Amount > q3 + 1.5 * (q3 - q1)) AS n_high
FROM fences""",
        r6("q1", "q3", "iqr", "lower", "upper"),
    )
    onehot = ", ".join(f"CASE WHEN {_band_ord('Amount')} = {i} THEN 1 ELSE 0 END AS Amount_bin_{n}" for i, n in enumerate(BAND_NAMES))
    o["amount_bands"] = q(
        [],
        f"SELECT txn_id, Amount, {_band_ord('Amount')} AS Amount_bin_ord, ({_list(BAND_NAMES)})[{_band_ord('Amount')} + 1] AS Amount_bin, {onehot} FROM transactions",
        r6("Amount"),
    )
    o["engineered_features"] = q([CLEAN, WRANGLED], "SELECT * FROM wrangled", r6(*WRANGLED_DOUBLES))

    split_ctes = [CLEAN, WRANGLED, SPLIT]
    o["stratified_split"] = q(split_ctes, 'SELECT txn_id, "Class", split FROM splitted')
    o["split_report"] = q(
        split_ctes,
        'SELECT split, count(*) AS rows, count(*) FILTER (WHERE "Class" = 1) AS positives, '
        'count(*) FILTER (WHERE "Class" = 1) * 100.0 / count(*) AS rate_pct FROM splitted GROUP BY split',
        r6("rate_pct"),
    )
    o["saved_splits"] = q(
        split_ctes,
        """SELECT saved, txn_id, "Class", Amount_log FROM splitted
JOIN (VALUES ('wrangled', NULL), ('train', 'train'), ('test', 'test')) t(saved, part) ON part IS NULL OR part = split""",
        r6("Amount_log"),
    )
    three = 'txn_id, "Class", Amount_log, V14, Time_hour'
    o["saved_balanced"] = q(
        split_ctes + [SCALED, *_smote_ctes()],
        f"""SELECT 'wrangled' AS saved, {three} FROM splitted UNION ALL SELECT 'train', {three} FROM balanced
UNION ALL SELECT 'test', {three} FROM scaled WHERE split = 'test'""",
        r6("Amount_log", "V14"),
    )
    o["smote_balanced"] = q(split_ctes + [SCALED, *_smote_ctes()], "SELECT * FROM balanced", r6(*WRANGLED_DOUBLES, *SCALE_COLS))
    o["scaled_train"] = q(split_ctes + [SCALED], "SELECT * FROM scaled", r6(*WRANGLED_DOUBLES, *SCALE_COLS))
    o["class_weights"] = q(
        split_ctes,
        """SELECT "Class", count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
FROM splitted WHERE split = 'train' GROUP BY "Class\"""",
        r6("weight"),
    )

    # ------------------------------------------------------------ rates
    vc = [CLEAN, VIEW]
    rate_hour = (
        'SELECT "Hour", count(*) FILTER (WHERE "Class" = 1) AS positives, count(*) AS total, '
        'count(*) - count(*) FILTER (WHERE "Class" = 1) AS negatives, '
        'count(*) FILTER (WHERE "Class" = 1) * 100.0 / count(*) AS rate_pct FROM view GROUP BY "Hour"'
    )
    o["rate_by_hour"] = q(vc, rate_hour, r6("rate_pct"))
    o["peak_hour"] = q(vc + [f"r AS ({rate_hour})"], 'SELECT "Hour", rate_pct FROM r ORDER BY rate_pct DESC, "Hour" LIMIT 1', r6("rate_pct"))
    o["volume_by_hour"] = q(
        vc,
        'SELECT "Hour", count(*) FILTER (WHERE "Class" = 0) AS negatives, count(*) FILTER (WHERE "Class" = 1) AS positives FROM view GROUP BY "Hour"',
    )
    o["hour_spine"] = q(
        vc + [f"r AS ({rate_hour})",
              'h AS (SELECT CAST(range AS INTEGER) AS "Hour" FROM range(24))',
              """j AS (SELECT h."Hour", coalesce(positives, 0) AS positives, coalesce(total, 0) AS total,
                  coalesce(negatives, 0) AS negatives, coalesce(rate_pct, 0.0) AS rate_pct FROM h LEFT JOIN r USING ("Hour"))"""],
        """SELECT "Hour", positives, total, negatives, rate_pct, rate_pct > avg(rate_pct) OVER () AS above_mean,
       rate_pct > (SELECT median(rate_pct) FROM r) AS above_median FROM j""",
        r6("rate_pct"),
    )
    o["rate_by_band"] = q(
        vc + ["""b AS (SELECT Amount_band_ord, Amount_band, count(*) FILTER (WHERE "Class" = 1) AS positives, count(*) AS total,
                 coalesce(sum(CASE WHEN "Class" = 1 THEN Amount END), 0.0) AS exposure
                 FROM view WHERE Amount_band_ord IS NOT NULL GROUP BY Amount_band_ord, Amount_band)"""],
        """SELECT Amount_band_ord, Amount_band, positives, total, positives * 100.0 / total AS rate_pct, exposure,
       positives * 100.0 / total > avg(positives * 100.0 / total) OVER () AS above_mean FROM b""",
        r6("rate_pct", "exposure"),
    )
    rate_band_body = """SELECT Amount_band_ord, Amount_band, positives, total, positives * 100.0 / total AS rate_pct, exposure,
       positives * 100.0 / total > avg(positives * 100.0 / total) OVER () AS above_mean FROM b"""
    band_cte = """b AS (SELECT Amount_band_ord, Amount_band, count(*) FILTER (WHERE "Class" = 1) AS positives, count(*) AS total,
                 coalesce(sum(CASE WHEN "Class" = 1 THEN Amount END), 0.0) AS exposure
                 FROM view WHERE Amount_band_ord IS NOT NULL GROUP BY Amount_band_ord, Amount_band)"""
    o["rate_by_band_rare"] = q(vc + [band_cte], rate_band_body, r6("rate_pct", "exposure"), variant="rare")
    o["exposure_by_band_rare"] = q(
        vc,
        """SELECT Amount_band_ord, Amount_band, sum(Amount) AS exposure, count(*) AS cases, avg(Amount) AS avg_amount
FROM view WHERE "Class" = 1 AND Amount_band_ord IS NOT NULL GROUP BY Amount_band_ord, Amount_band""",
        r6("exposure", "avg_amount"),
        variant="rare",
    )
    o["scorecard_rare"] = q(vc + _scorecard_ctes("view", "view"), SCORECARD_BODY, r6("value"), variant="rare")
    o["exposure_by_band"] = q(
        vc,
        """SELECT Amount_band_ord, Amount_band, sum(Amount) AS exposure, count(*) AS cases, avg(Amount) AS avg_amount
FROM view WHERE "Class" = 1 AND Amount_band_ord IS NOT NULL GROUP BY Amount_band_ord, Amount_band""",
        r6("exposure", "avg_amount"),
    )
    o["peak_band"] = q(
        vc + [band_cte],
        "SELECT Amount_band_ord, positives * 100.0 / total AS rate_pct FROM b ORDER BY rate_pct DESC, Amount_band_ord LIMIT 1",
        r6("rate_pct"),
    )
    o["range_exposure"] = q(
        vc,
        """SELECT 100.0::DOUBLE AS lo, 500.0::DOUBLE AS hi, count(*) FILTER (WHERE "Class" = 1 AND Amount BETWEEN 100.0 AND 500.0) AS positives,
       coalesce(sum(Amount) FILTER (WHERE "Class" = 1 AND Amount BETWEEN 100.0 AND 500.0), 0.0) AS exposure FROM view""",
        r6("lo", "hi", "exposure"),
    )
    o["band_composition"] = q(
        vc,
        """SELECT Amount_band_ord, "Class", count(*) AS count, sum(Amount) AS amount_total,
       CAST(grouping_id(Amount_band_ord, "Class") AS BIGINT) AS level
FROM view WHERE Amount_band_ord IS NOT NULL GROUP BY ROLLUP (Amount_band_ord, "Class")""",
        r6("amount_total"),
    )
    o["day_crosstab"] = q(
        vc,
        """SELECT Day_label, count(*) FILTER (WHERE "Class" = 0) AS negatives, count(*) FILTER (WHERE "Class" = 1) AS positives,
       count(*) FILTER (WHERE "Class" = 1) * 100.0 / (count(*) FILTER (WHERE "Class" = 0) + count(*) FILTER (WHERE "Class" = 1)) AS rate_pct
FROM view WHERE Day_label IS NOT NULL GROUP BY Day_label""",
        r6("rate_pct"),
    )
    o["exposure_summary"] = q(
        vc,
        """SELECT count(*) FILTER (WHERE "Class" = 1) AS pos_count,
       coalesce(sum(Amount) FILTER (WHERE "Class" = 1), 0.0) AS pos_total,
       avg(Amount) FILTER (WHERE "Class" = 1) AS pos_mean, max(Amount) FILTER (WHERE "Class" = 1) AS pos_max,
       count(*) FILTER (WHERE "Class" = 0) AS neg_count,
       coalesce(sum(Amount) FILTER (WHERE "Class" = 0), 0.0) AS neg_total,
       avg(Amount) FILTER (WHERE "Class" = 0) AS neg_mean, max(Amount) FILTER (WHERE "Class" = 0) AS neg_max
FROM view""",
        r6("pos_total", "pos_mean", "pos_max", "neg_total", "neg_mean", "neg_max"),
    )
    o["day_night_split"] = q(
        vc,
        """SELECT count(*) FILTER (WHERE "Class" = 1) AS positives,
       count(*) FILTER (WHERE "Class" = 1 AND "Hour" BETWEEN 8 AND 19) AS day_positives,
       count(*) FILTER (WHERE "Class" = 1 AND NOT ("Hour" BETWEEN 8 AND 19)) AS night_positives,
       count(*) FILTER (WHERE "Class" = 1 AND "Hour" BETWEEN 8 AND 19) * 100.0 / NULLIF(count(*) FILTER (WHERE "Class" = 1), 0) AS day_pct,
       count(*) FILTER (WHERE "Class" = 1 AND NOT ("Hour" BETWEEN 8 AND 19)) * 100.0 / NULLIF(count(*) FILTER (WHERE "Class" = 1), 0) AS night_pct,
       count(*) FILTER (WHERE "Hour" BETWEEN 8 AND 19) AS day_total,
       count(*) FILTER (WHERE NOT ("Hour" BETWEEN 8 AND 19)) AS night_total
FROM view""",
        r6("day_pct", "night_pct"),
    )
    o["scorecard"] = q(vc + _scorecard_ctes("view", "view"), SCORECARD_BODY, r6("value"))
    filt = "Day_label IN ('Day 2') AND \"Hour\" BETWEEN 2 AND 20 AND Amount <= 500.0"
    o["filtered_view"] = q(
        vc,
        f'SELECT txn_id, "Time", Amount, "Class", "Hour", Day_label, Amount_band, fraud_score FROM view WHERE {filt}',
        r6("Time", "Amount", "fraud_score"),
    )
    o["scorecard_empty_filter"] = q(
        vc + ["fview AS (SELECT * FROM view WHERE Day_label = 'Day 9')"] + _scorecard_ctes("fview", "view"), SCORECARD_BODY, r6("value")
    )
    o["filtered_scorecard"] = q(
        vc + [f"fview AS (SELECT * FROM view WHERE {filt})"] + _scorecard_ctes("fview", "view"), SCORECARD_BODY, r6("value")
    )

    cards = []
    for i, where in enumerate(CUBE_PREDICATES):
        ctes = [f"fview AS (SELECT * FROM view WHERE {where})", *_scorecard_ctes("fview", "view")]
        cards.append(f"SELECT *, {i} AS filter FROM (WITH " + ",\n".join(ctes) + f"\n{SCORECARD_BODY})")
    o["cube_scorecard"] = q(vc, "\nUNION ALL ".join(cards), r6("value"))

    # ------------------------------------------------------------ timing
    pos = 'SELECT "Time" FROM cleaned WHERE "Class" = 1 AND "Time" IS NOT NULL'
    gaps = f'gaps AS (SELECT "Time", ("Time" - lag("Time") OVER (ORDER BY "Time")) / 60.0 AS gap_min FROM ({pos}))'
    o["positive_gaps"] = q([CLEAN, gaps], "SELECT * FROM gaps WHERE gap_min IS NOT NULL", r6("Time", "gap_min"))
    o["gap_quantiles"] = q(
        [CLEAN, gaps],
        "SELECT count(*) AS n_gaps, quantile_cont(gap_min, 0.1) AS p10_min, quantile_cont(gap_min, 0.5) AS median_min FROM gaps WHERE gap_min IS NOT NULL",
        r6("p10_min", "median_min"),
    )
    o["gap_quantiles_clipped"] = q(
        [CLEAN, gaps],
        "SELECT count(*) AS n_gaps, quantile_cont(least(gap_min, 200.0), 0.1) AS p10_min, "
        "quantile_cont(least(gap_min, 200.0), 0.5) AS median_min FROM gaps WHERE gap_min IS NOT NULL",
        r6("p10_min", "median_min"),
    )
    arr = """arr AS (SELECT "Class", "Time", "Time" / 3600 AS hours,
       row_number() OVER (PARTITION BY "Class" ORDER BY "Time") AS seq, count(*) OVER (PARTITION BY "Class") AS n
FROM cleaned WHERE "Time" IS NOT NULL)"""
    o["cumulative_arrival"] = q([CLEAN, arr], 'SELECT "Class", "Time", hours, seq, seq * 100.0 / n AS cum_pct FROM arr', r6("Time", "hours", "cum_pct"))
    o["cumulative_arrival_even"] = q(
        [CLEAN, arr],
        'SELECT "Class", "Time", hours, seq, CASE WHEN n > 1 THEN (seq - 1) * 100.0 / (n - 1) ELSE 0.0 END AS cum_pct FROM arr',
        r6("Time", "hours", "cum_pct"),
    )

    # ------------------------------------------------------------ separation
    lngl = f"lngl AS ({unpivot_union(V, 'cleaned', ', \"Class\" AS lbl')})"
    ks_ctes = [
        CLEAN,
        lngl,
        """cnt AS (SELECT "column", col_idx, value, count(*) FILTER (WHERE lbl = 0) AS n0, count(*) FILTER (WHERE lbl = 1) AS n1
                 FROM lngl WHERE value IS NOT NULL GROUP BY "column", col_idx, value)""",
        """cum AS (SELECT "column", col_idx,
                 sum(n0) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) AS c0,
                 sum(n1) OVER (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING) AS c1,
                 sum(n0) OVER (PARTITION BY "column") AS t0, sum(n1) OVER (PARTITION BY "column") AS t1 FROM cnt)""",
        """ks0 AS (SELECT "column", col_idx, max(abs(c0 / t0 - c1 / t1)) AS ks, CAST(max(t0) AS BIGINT) AS n_neg, CAST(max(t1) AS BIGINT) AS n_pos
                 FROM cum GROUP BY "column", col_idx)""",
        f"""ks AS (SELECT "column", col_idx, ks, {_ksf('sqrt(n_neg * n_pos / (n_neg + n_pos)) * ks')} AS p_value, n_neg, n_pos
                 FROM ks0 WHERE n_neg > 0 AND n_pos > 0)""",
    ]
    o["feature_ks"] = q(ks_ctes, "SELECT * FROM ks", r6("ks", "p_value"))
    # the share of lattice paths that stay inside the band of the statistic, row by row; as the operator, for 10,000 values a sample
    finite = [
        *ks_ctes[:-1],
        """band AS (SELECT *, a // gcd(a, b) AS ag, b // gcd(a, b) AS bg, CAST(round(ks * a * (b // gcd(a, b))) AS BIGINT) AS h
                 FROM (SELECT "column", ks, least(n_neg, n_pos) AS a, greatest(n_neg, n_pos) AS b FROM ks0 WHERE n_neg > 0 AND n_pos > 0))""",
        """walk("column", i, j, w) AS (
                 SELECT "column", 0::BIGINT, unnest(range(0, CAST(least(b, ceil(h / ag) - 1) AS BIGINT) + 1)), 1.0::DOUBLE FROM band
                 UNION ALL
                 SELECT "column", i, j, sum(w) OVER (PARTITION BY "column" ORDER BY j ROWS UNBOUNDED PRECEDING) * i / (b + i)
                 FROM (SELECT *, CASE WHEN j = was THEN w0 ELSE 0.0 END AS w
                       FROM (SELECT "column", walk.i + 1 AS i, b, walk.j AS was, walk.w AS w0,
                               floor((walk.i * bg + bg - h) / ag) + 1 AS lo,
                               unnest(range(walk.j, CASE WHEN walk.j = least(b, ceil((walk.i * bg + h) / ag) - 1)
                                 THEN CAST(least(b, ceil((walk.i * bg + bg + h) / ag) - 1) AS BIGINT) ELSE walk.j END + 1)) AS j
                             FROM walk JOIN band USING ("column") WHERE walk.i < a)
                       WHERE j >= lo))""",
        """law AS (SELECT "column", CASE WHEN h <= 0 THEN 1.0 WHEN b <= 10000 THEN 1 - w
                        ELSE error('no twin for the law of samples beyond 10,000 values') END AS p_value
                 FROM band LEFT JOIN (SELECT "column", w, i, j FROM walk) USING ("column") WHERE h <= 0 OR (i = a AND j = b))""",
    ]
    o["feature_ks_finite"] = q(
        finite,
        'SELECT "column", col_idx, ks, p_value, n_neg, n_pos FROM ks0 JOIN law USING ("column")',
        r6("ks", "p_value", d=12),
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    means = """means AS (SELECT "column", col_idx, avg(value) FILTER (WHERE lbl = 1) AS pos_mean, avg(value) FILTER (WHERE lbl = 0) AS neg_mean,
       stddev_samp(value) FILTER (WHERE lbl = 1) AS pos_std, stddev_samp(value) FILTER (WHERE lbl = 0) AS neg_std,
       corr(value, CAST(lbl AS DOUBLE)) AS corr FROM lngl GROUP BY "column", col_idx)"""
    o["label_means"] = q([CLEAN, lngl, means], "SELECT * FROM means", r6("pos_mean", "neg_mean", "pos_std", "neg_std", "corr"))
    lngr = f"lngl AS ({unpivot_union(list(RADAR_FEATURES), 'cleaned', ', \"Class\" AS lbl')})"
    o["radar_profile"] = q(
        [CLEAN, lngr, means],
        """SELECT "column", col_idx, pos_mean, neg_mean,
       (pos_mean - least(pos_mean, neg_mean)) / CASE WHEN greatest(pos_mean, neg_mean) - least(pos_mean, neg_mean) = 0 THEN 1.0
            ELSE greatest(pos_mean, neg_mean) - least(pos_mean, neg_mean) END AS pos_norm,
       (neg_mean - least(pos_mean, neg_mean)) / CASE WHEN greatest(pos_mean, neg_mean) - least(pos_mean, neg_mean) = 0 THEN 1.0
            ELSE greatest(pos_mean, neg_mean) - least(pos_mean, neg_mean) END AS neg_norm
FROM means""",
        r6("pos_mean", "neg_mean", "pos_norm", "neg_norm"),
    )
    o["feature_ranking"] = q(
        ks_ctes + [means],
        'SELECT ks."column", ks.col_idx, ks, p_value, n_neg, n_pos, pos_mean, neg_mean, pos_std, neg_std, corr FROM ks JOIN means USING ("column")',
        r6("ks", "p_value", "pos_mean", "neg_mean", "pos_std", "neg_std", "corr"),
    )
    o["feature_detail"] = o["feature_ranking"].replace('JOIN means USING ("column")', "JOIN means USING (\"column\") WHERE \"column\" = 'V14'")
    o["histogram_by_label"] = q([CLEAN], _hist_sql("cleaned", "Amount_log", 60), r6("bin_lo", "bin_hi", "density"))
    o["score_histogram"] = q([CLEAN, VIEW], _hist_sql("view", "fraud_score", 50), r6("bin_lo", "bin_hi", "density"))
    o["density_by_label"] = q([CLEAN], _kde_sql("cleaned", "least(Amount, 500.0)", "0.0", "500.0"), r6("x", "density", d=9))
    o["density_scott"] = q(
        [CLEAN], _kde_sql("cleaned", "least(Amount, 500.0)", "0.0", "500.0", "pow(count(*), -0.2)"), r6("x", "density", d=9)
    )
    o["density_log_amount"] = q([CLEAN], _kde_sql("cleaned", "Amount_log", None, None), r6("x", "density", d=9))
    o["density_feature"] = q(
        [CLEAN], _kde_sql("cleaned", "least(greatest(V17, -10.0), 10.0)", "-10.0", "10.0"), r6("x", "density", d=9)
    )
    o["box_stats_feature"] = q(
        [CLEAN,
         'bx AS (SELECT "Class" AS lbl, least(greatest(V14, -10.0), 10.0) AS v FROM cleaned WHERE V14 IS NOT NULL)',
         "bq AS (SELECT lbl, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM bx GROUP BY lbl)"],
        BOX_BODY,
        r6("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi", "mean", "notch_lo", "notch_hi"),
    )
    o["gap_histogram"] = q(
        [CLEAN, gaps, 'gx AS (SELECT 1 AS "Class", least(gap_min, 200.0) AS g FROM gaps WHERE gap_min IS NOT NULL)'],
        _hist_sql("gx", "g", 60),
        r6("bin_lo", "bin_hi", "density"),
    )
    o["volume_by_hour_parity"] = q(
        vc,
        """SELECT n."Hour", n.negatives, coalesce(p.positives, 0) AS positives
FROM (SELECT "Hour", count(*) AS negatives FROM view WHERE "Class" = 0 GROUP BY "Hour") n
LEFT JOIN (SELECT "Hour", count(*) AS positives FROM view WHERE "Class" = 1 GROUP BY "Hour") p USING ("Hour")""",
    )
    o["box_stats"] = q(
        [CLEAN,
         'bx AS (SELECT "Class" AS lbl, least(Amount, 500.0) AS v FROM cleaned WHERE Amount IS NOT NULL)',
         "bq AS (SELECT lbl, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM bx GROUP BY lbl)"],
        BOX_BODY,
        r6("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi", "mean", "notch_lo", "notch_hi"),
    )

    # ------------------------------------------------------------ scoring
    o["scored"] = q(vc, 'SELECT txn_id, "Class", fraud_score FROM view', r6("fraud_score"))
    metrics = """SELECT {t} AS threshold, flagged, true_pos, false_pos, positives,
       true_pos / greatest(positives, 1) * 100 AS recall_pct, true_pos / greatest(flagged, 1) * 100 AS precision_pct,
       exposure_caught, exposure_missed FROM m"""
    o["threshold_metrics"] = q(
        vc
        + ["""m AS (SELECT count(*) FILTER (WHERE fraud_score >= 0.6) AS flagged,
                 count(*) FILTER (WHERE fraud_score >= 0.6 AND "Class" = 1) AS true_pos,
                 count(*) FILTER (WHERE fraud_score >= 0.6 AND "Class" = 0) AS false_pos,
                 count(*) FILTER (WHERE "Class" = 1) AS positives,
                 coalesce(sum(Amount) FILTER (WHERE fraud_score >= 0.6 AND "Class" = 1), 0.0) AS exposure_caught,
                 coalesce(sum(Amount) FILTER (WHERE NOT coalesce(fraud_score >= 0.6, false) AND "Class" = 1), 0.0) AS exposure_missed
                 FROM view)"""],
        metrics.format(t="0.6::DOUBLE"),
        r6("threshold", "recall_pct", "precision_pct", "exposure_caught", "exposure_missed"),
    )
    o["threshold_sweep"] = q(
        vc
        + ["th AS (SELECT range AS k, CAST(range AS DOUBLE) / 100.0 AS t FROM range(101))",
           """m AS (SELECT th.t AS threshold, count(*) FILTER (WHERE v.fraud_score >= th.t) AS flagged,
                 count(*) FILTER (WHERE v.fraud_score >= th.t AND v."Class" = 1) AS true_pos,
                 count(*) FILTER (WHERE v.fraud_score >= th.t AND v."Class" = 0) AS false_pos,
                 count(*) FILTER (WHERE v."Class" = 1) AS positives,
                 coalesce(sum(v.Amount) FILTER (WHERE v.fraud_score >= th.t AND v."Class" = 1), 0.0) AS exposure_caught,
                 coalesce(sum(v.Amount) FILTER (WHERE v."Class" = 1), 0.0) AS exposure
                 FROM th, view v GROUP BY th.t)"""],
        """SELECT threshold, flagged, true_pos, false_pos, positives, true_pos / greatest(positives, 1) * 100 AS recall_pct,
       true_pos / greatest(flagged, 1) * 100 AS precision_pct, exposure_caught, exposure - exposure_caught AS exposure_missed FROM m""",
        r6("threshold", "recall_pct", "precision_pct", "exposure_caught", "exposure_missed"),
    )
    top = """SELECT txn_id, "Time", Amount, "Hour", Day_label, Amount_band, round(fraud_score, 4) AS fraud_score,
       CASE WHEN "Class" = 0 THEN 'LEGIT' WHEN "Class" = 1 THEN 'FRAUD' END AS Class_label
FROM view {where} ORDER BY fraud_score DESC NULLS LAST, txn_id LIMIT {n}"""
    o["top_flagged"] = q(vc, top.format(where="", n=50), r6("Time", "Amount", "fraud_score"))
    o["top_flagged_only"] = q(vc, top.format(where="WHERE fraud_score >= 0.30", n=50), r6("Time", "Amount", "fraud_score"))
    o["top_flagged_negative"] = q(vc, top.format(where='WHERE "Class" = 0', n=25), r6("Time", "Amount", "fraud_score"))
    o["sample_rows"] = q(
        vc,
        """SELECT txn_id, Amount, fraud_score, "Class", "Hour", Day_label, Amount_band FROM view
ORDER BY md5(CAST(txn_id AS VARCHAR) || '#42'), txn_id LIMIT 5000""",
        r6("Amount", "fraud_score"),
    )

    o["smote_summary"] = q(
        split_ctes,
        """SELECT "Class", count(*) AS before, max(count(*)) OVER () AS after FROM splitted WHERE split = 'train' GROUP BY "Class\"""",
    )

    # ------------------------------------------------------------ streaming twins
    o["stream_hourly_rate"] = q(
        [],
        """SELECT time_bucket(INTERVAL 1 HOUR, e.ts) AS window_start, time_bucket(INTERVAL 1 HOUR, e.ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS total, count(*) FILTER (WHERE b."Class" = 1) AS positives,
       count(*) FILTER (WHERE b."Class" = 1) * 100.0 / count(*) AS rate_pct,
       coalesce(sum(b.Amount) FILTER (WHERE b."Class" = 1), 0.0) AS exposure
FROM base b JOIN events e ON e.event_id = b.txn_id GROUP BY 1, 2""",
        r6("rate_pct", "exposure"),
    )
    o["stream_velocity"] = q(
        [],
        """SELECT user_id, ts FROM (
  SELECT user_id, ts, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events
) WHERE p IS NOT NULL AND epoch(ts) - epoch(p) < 300""",
    )
    capped = "least(greatest(b.Amount, greatest(f.q1 - 1.5 * (f.q3 - f.q1), 0.0)), f.q3 + 1.5 * (f.q3 - f.q1))"
    stream_inputs = [f"ln(1 + {capped})" if c == "Amount_log" else _score_input(c, a, "b.") for c, _, a in SCORE_TERMS]
    o["stream_score"] = q(
        [CLEAN,
         f"sp AS (SELECT {SCORE_MAXIMA} FROM cleaned)",
         f"sc AS (SELECT b.txn_id, b.\"Class\", b.Amount, {_score_sql(stream_inputs)} AS fraud_score FROM base b, sp, fences f)"],
        "SELECT txn_id, \"Class\", Amount, fraud_score, fraud_score >= 0.6 AS flagged FROM sc",
        r6("Amount", "fraud_score"),
    )
    o["incremental_rates"] = q(
        [],
        """SELECT CAST(floor(("Time" % 86400) / 3600) AS INTEGER) AS "Hour", count(*) AS total, count(*) FILTER (WHERE "Class" = 1) AS positives,
       count(*) FILTER (WHERE "Class" = 1) * 100.0 / count(*) AS rate_pct,
       coalesce(sum(Amount) FILTER (WHERE "Class" = 1), 0.0) AS exposure FROM base GROUP BY 1""",
        r6("rate_pct", "exposure"),
    )

    # ------------------------------------------------------------ streams, run live
    o["live_score"] = o["stream_score"]
    o["live_hourly_rate"] = q(
        [*ARRIVALS,
         """behind AS (SELECT s.slot, max(epoch_ms(a.ts)) - 3600000 AS wm FROM (SELECT DISTINCT slot FROM arr) s
  LEFT JOIN arr a ON a.slot < s.slot GROUP BY s.slot)""",
         """hours AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end FROM arr)"""],
        """SELECT window_start, window_end,
       count(*) AS total, count(*) FILTER (WHERE b."Class" = 1) AS positives,
       count(*) FILTER (WHERE b."Class" = 1) * 100.0 / count(*) AS rate_pct,
       coalesce(sum(b.Amount) FILTER (WHERE b."Class" = 1), 0.0) AS exposure
FROM base b JOIN hours e ON e.event_id = b.txn_id JOIN behind USING (slot)
WHERE (wm IS NULL OR epoch_ms(window_end) > wm) AND epoch_ms(window_end) <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)
GROUP BY 1, 2""",
        r6("rate_pct", "exposure"),
    )
    passed = f"epoch_us(ts) <= (SELECT max(epoch_ms(ts)) - {27 * 3600000} FROM events) * 1000"
    o["live_velocity"] = q(
        [],
        f"""SELECT user_id, ts FROM (
  SELECT user_id, ts, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events
) WHERE p IS NOT NULL AND epoch_us(ts) - epoch_us(p) < 300000000 AND {passed}""",
    )
    o["live_bursts"] = q(
        ["""steps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))""",
         "islands AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM steps)"],
        f"""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM islands GROUP BY user_id, run
HAVING count(*) > 2 AND epoch_us(max(ts)) + 7200000000 <= (SELECT max(epoch_ms(ts)) - {27 * 3600000} FROM events) * 1000""",
    )
    o["live_dedup"] = "SELECT * FROM events"
    return o


#: the filters of ``cube_scorecard``, in order
CUBE_PREDICATES = (
    "Day_label IN ('Day 1', 'Day 2') AND Amount IS NOT NULL",
    "Day_label = 'Day 2' AND \"Hour\" BETWEEN 2 AND 20 AND Amount <= 500.0",
    "Day_label = 'Day 9'",
    "Day_label = 'Day 1' AND \"Hour\" BETWEEN 0 AND 11 AND Amount <= 37.5",
    "Day_label IN ('Day 1', 'Day 2') AND \"Hour\" BETWEEN 8 AND 19 AND Amount <= 0.0",
)
_AT = f"epoch_us(ts) + CAST(CASE event_id % {LATE_MOD} WHEN 7 THEN {LATE_HOURS * 60} WHEN 11 THEN 40 ELSE 0 END AS BIGINT) * 60000000"
ARRIVALS = [
    f"arr0 AS (SELECT *, {_AT} AS due FROM events)",
    f"arr AS (SELECT *, (due - min(due) OVER ()) * {ARRIVAL_SLOTS} // (max(due) OVER () - min(due) OVER () + 1) AS slot FROM arr0)",
]


# ---------------------------------------------------------------- shared pieces
BOX_BODY = """SELECT bq.lbl AS "Class", count(*) AS n, q1, median, q3, q3 - q1 AS iqr,
       min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       avg(v) AS mean, median - 1.57 * (q3 - q1) / sqrt(count(*)) AS notch_lo, median + 1.57 * (q3 - q1) / sqrt(count(*)) AS notch_hi,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM bx JOIN bq USING (lbl) GROUP BY bq.lbl, q1, median, q3"""
WRANGLED_DOUBLES = ["Time_scaled", "Amount_log", *V, "V_mean", "V_std", "V_min", "V_max", "V_range", "V14_x_V17", "V14_x_V12"]
SCALE_COLS = [*V, "V_mean", "V_std", "V_min", "V_max", "V_range", "V_pos_ct", "V_neg_ct", "V14_x_V17", "V14_x_V12", "Amount_log", "Time_scaled"]


def _rowstats() -> str:
    n = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN 1 ELSE 0 END" for v in V)
    s = "0.0 + " + " + ".join(f"coalesce({v}, 0.0)" for v in V)
    return n, s


def _wrangled() -> str:
    n, s = _rowstats()
    onehot = ", ".join(f"CASE WHEN {_band_ord('Amount')} = {i} THEN 1 ELSE 0 END AS Amount_bin_{nm}" for i, nm in enumerate(BAND_NAMES))
    pos = " + ".join(f"CASE WHEN {v} > 0 THEN 1 ELSE 0 END" for v in V)
    neg = " + ".join(f"CASE WHEN {v} < 0 THEN 1 ELSE 0 END" for v in V)
    ss = "0.0 + " + " + ".join(f"coalesce(({v} - V_mean) * ({v} - V_mean), 0.0)" for v in V)
    return f"""w1 AS (
  SELECT *, CASE WHEN ({n}) > 0 THEN ({s}) / ({n}) END AS V_mean, ({n}) AS _n FROM cleaned
),
wrangled AS (
  SELECT txn_id, {VL}, "Class", is_zero_amount, Amount_log, Time_scaled,
         {HOUR} AS Time_hour,
         CASE WHEN {HOUR} >= 8 AND {HOUR} < 20 THEN 1 ELSE 0 END AS is_daytime,
         {DAY} AS Day_period,
         {onehot},
         V_mean, CASE WHEN _n > 1 THEN sqrt(({ss}) / (_n - 1)) END AS V_std,
         least({VL}) AS V_min, greatest({VL}) AS V_max, greatest({VL}) - least({VL}) AS V_range,
         CAST({pos} AS INTEGER) AS V_pos_ct, CAST({neg} AS INTEGER) AS V_neg_ct,
         V14 * V17 AS V14_x_V17, V14 * V12 AS V14_x_V12
  FROM w1
)"""


WRANGLED = _wrangled()

SPLIT = """rk AS (
  SELECT *, row_number() OVER (PARTITION BY "Class" ORDER BY md5(CAST(txn_id AS VARCHAR) || '#42'), txn_id) AS _rn,
         count(*) OVER (PARTITION BY "Class") AS _cnt
  FROM wrangled
),
splitted AS (
  SELECT * EXCLUDE (_rn, _cnt), CASE WHEN _rn <= ceil(0.2 * _cnt) THEN 'test' ELSE 'train' END AS split FROM rk
)"""


def _scaled() -> str:
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in SCALE_COLS
    )
    rep = ", ".join(f"(CAST(s.{c} AS DOUBLE) - p.m_{c}) / p.s_{c} AS {c}" for c in SCALE_COLS)
    return f"""sstat AS (SELECT {stats} FROM splitted WHERE split = 'train'),
scaled AS (SELECT s.* REPLACE ({rep}) FROM splitted s, sstat p)"""


SCALED = _scaled()


def _smote_ctes(k: int = 5, seed: int = 42) -> list[str]:
    """SMOTE of the positives up to the negatives' count (two classes, positives the smaller)."""
    bins = [f"Amount_bin_{b}" for b in BAND_NAMES]
    whole = ["is_zero_amount", "Time_hour", "is_daytime", "Day_period", *bins]
    feats = [*whole, *SCALE_COLS]
    vec = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in feats) + "]"
    draw = lambda seed, digits: f"CAST('0x' || substr(md5(CAST(g AS VARCHAR) || '#{seed}'), 1, {digits}) AS BIGINT)"
    mix = {c: f"x[{i}] + u * (y[{i}] - x[{i}])" for i, c in enumerate(feats, 1)}
    made = ", ".join(f"CAST(trunc({mix[c]}) AS INTEGER) AS {c}" if c in whole else f"{mix[c]} AS {c}" for c in feats)
    cols = ", ".join(feats)
    return [
        "train AS (SELECT * EXCLUDE (split) FROM scaled WHERE split = 'train')",
        f"""pos AS (SELECT row_number() OVER (ORDER BY md5(CAST(txn_id AS VARCHAR) || '#{seed}')) - 1 AS sid, {vec} AS v
          FROM train WHERE "Class" = 1)""",
        """sizes AS (SELECT count(*) FILTER (WHERE "Class" = 1) AS m, count(*) FILTER (WHERE "Class" = 0) AS n FROM train)""",
        f"""knn AS (SELECT * FROM (SELECT a.sid, b.sid AS nb,
            row_number() OVER (PARTITION BY a.sid ORDER BY list_distance(a.v, b.v), b.sid) AS rk
          FROM pos a JOIN pos b ON a.sid <> b.sid) WHERE rk <= {k})""",
        f"""gen AS (SELECT {draw(seed, 15)} % m AS base, {draw(seed + 1, 15)} % least({k}, m - 1) + 1 AS j,
            CAST({draw(seed + 2, 13)} AS DOUBLE) / 4503599627370496.0 AS u
          FROM sizes, LATERAL (SELECT unnest(range(greatest(n - m, 0))) AS g))""",
        """pairs AS (SELECT a.v AS x, b.v AS y, u FROM gen JOIN knn ON knn.sid = base AND rk = j
          JOIN pos a ON a.sid = base JOIN pos b ON b.sid = nb)""",
        f"""balanced AS (SELECT txn_id, "Class", {cols}, false AS synthetic FROM train
          UNION ALL SELECT NULL AS txn_id, 1 AS "Class", {made}, true AS synthetic FROM pairs)""",
    ]


def _ksf(z: str) -> str:
    big = " + ".join(f"{2.0 * (1 if k % 2 else -1)} * exp({-2.0 * k * k} * ({z}) * ({z}))" for k in range(1, 21))
    import math

    small = " + ".join(f"exp({-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0} / (({z}) * ({z})))" for k in range(1, 21))
    q = f"CASE WHEN ({z}) <= 0 THEN 1.0 WHEN ({z}) < 1 THEN 1.0 - {math.sqrt(2 * math.pi)} / ({z}) * ({small}) ELSE {big} END"
    return f"least(greatest({q}, 0.0), 1.0)"


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""WITH hx AS (SELECT "Class" AS lbl, CAST({col} AS DOUBLE) AS v FROM {src} WHERE {col} IS NOT NULL),
hs AS (SELECT lbl, count(*) AS n,
              CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM hx GROUP BY lbl),
hc AS (SELECT hx.lbl, least(greatest(CAST(floor((v - lo) * ({float(bins)} / (hi - lo))) AS INTEGER), 0), {bins - 1}) AS bin, count(*) AS c
       FROM hx JOIN hs USING (lbl) GROUP BY 1, 2),
sp AS (SELECT lbl, n, lo, hi, CAST(range AS INTEGER) AS bin FROM hs, range({bins}))
SELECT sp.lbl AS "Class", sp.bin, lo + sp.bin * ((hi - lo) / {bins}) AS bin_lo, lo + (sp.bin + 1) * ((hi - lo) / {bins}) AS bin_hi,
       coalesce(c, 0) AS count, coalesce(c, 0) / (n * ((hi - lo) / {bins})) AS density
FROM sp LEFT JOIN hc ON sp.lbl = hc.lbl AND sp.bin = hc.bin""".replace("WITH hx", "SELECT * FROM (WITH hx", 1) + ")"


def _kde_sql(src: str, expr: str, lo: str | None, hi: str | None, bw: str = "0.3") -> str:
    lo_e = lo if lo is not None else "min(v)"
    hi_e = hi if hi is not None else "max(v)"
    import math

    return f"""SELECT * FROM (WITH kx AS (SELECT "Class" AS lbl, CAST({expr} AS DOUBLE) AS v FROM {src} WHERE {expr} IS NOT NULL),
ks AS (SELECT lbl, count(*) AS n, stddev_samp(v) * {bw} AS h, {lo_e} AS lo, {hi_e} AS hi FROM kx GROUP BY lbl
       HAVING count(*) > 1 AND stddev_samp(v) > 0),
grid AS (SELECT lbl, n, h, range AS j,
                CASE WHEN range = 299 THEN hi ELSE range * ((hi - lo) / 299.0) + lo END AS x FROM ks, range(300)),
kv AS (SELECT lbl, v, count(*) AS c FROM kx GROUP BY lbl, v)
SELECT g.lbl AS "Class", CAST(g.j AS INTEGER) AS point, g.x,
       sum(kv.c * exp(-0.5 * ((g.x - kv.v) / g.h) * ((g.x - kv.v) / g.h))) / (g.n * g.h * {math.sqrt(2 * math.pi)}) AS density
FROM grid g JOIN kv ON g.lbl = kv.lbl GROUP BY g.lbl, g.j, g.x, g.n, g.h)"""


def _scorecard_ctes(src: str, peak_src: str) -> list[str]:
    return [
        f"""pk AS (SELECT "Hour" AS h, count(*) FILTER (WHERE "Class" = 1) * 100.0 / count(*) AS r FROM {peak_src}
               GROUP BY "Hour" ORDER BY r DESC, "Hour" LIMIT 1)""",
        f"""kp AS (SELECT CAST(count(*) AS DOUBLE) AS total_transactions,
       CAST(count(*) FILTER (WHERE "Class" = 1) AS DOUBLE) AS positives,
       coalesce(count(*) FILTER (WHERE "Class" = 1) * 100.0 / NULLIF(count(*), 0), 0.0) AS positive_rate_pct,
       CAST(count(*) FILTER (WHERE "Class" = 0) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE "Class" = 1), 0) AS imbalance_ratio,
       coalesce(sum(Amount) FILTER (WHERE "Class" = 1), 0.0) AS total_exposure,
       coalesce(avg(Amount) FILTER (WHERE "Class" = 1), 0.0) AS avg_positive_amount,
       avg(Amount) FILTER (WHERE "Class" = 0) AS avg_negative_amount,
       coalesce(max(Amount) FILTER (WHERE "Class" = 1), 0.0) AS max_positive_amount,
       CAST(count(*) FILTER (WHERE "Class" = 1 AND Amount = 0) AS DOUBLE) AS zero_amount_positives,
       CAST(count(*) FILTER (WHERE "Class" = 1 AND "Hour" BETWEEN 8 AND 19) AS DOUBLE) AS day_positives,
       CAST(count(*) FILTER (WHERE "Class" = 1 AND NOT ("Hour" BETWEEN 8 AND 19)) AS DOUBLE) AS night_positives
       FROM {src})""",
    ]


_METRICS = [
    "total_transactions", "positives", "positive_rate_pct", "imbalance_ratio", "total_exposure", "avg_positive_amount",
    "avg_negative_amount", "max_positive_amount", "zero_amount_positives", "peak_hour", "peak_hour_rate_pct",
    "day_positives", "night_positives",
]


def _scorecard_body() -> str:
    parts = []
    for i, m in enumerate(_METRICS):
        if m == "peak_hour":
            val = "(SELECT CAST(h AS DOUBLE) FROM pk)"
        elif m == "peak_hour_rate_pct":
            val = "(SELECT r FROM pk)"
        else:
            val = f"(SELECT {m} FROM kp)"
        parts.append(f"SELECT {i} AS ord, '{m}' AS metric, {val} AS value")
    return "\nUNION ALL ".join(parts)


SCORECARD_BODY = _scorecard_body()

ORACLE = _oracle()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
