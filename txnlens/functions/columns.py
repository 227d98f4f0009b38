"""Scalar column expressions (PR-*): time parts, bands, clipping, safe arithmetic.

All functions return ``Column`` objects built from Spark built-ins so that they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

SECONDS_PER_DAY = 86400
SECONDS_PER_HOUR = 3600


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL so Spark's null-skipping aggregates behave like pandas' skipna."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every float/double column, keeping names and order."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(nan_to_null(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def second_of_day(t: str | Column) -> Column:
    """Seconds into the day; ``pmod`` takes the divisor's sign like Python's ``%``."""
    return F.pmod(col(t), F.lit(float(SECONDS_PER_DAY)))


def hour_of_day(t: str | Column) -> Column:
    """Hour 0-23 from seconds since the recording start."""
    return F.floor(second_of_day(t) / SECONDS_PER_HOUR).cast("int")


def day_index(t: str | Column) -> Column:
    """0-based day number (floor division, so negative times give negative days)."""
    return F.floor(col(t) / SECONDS_PER_DAY).cast("int")


def day_label(day: str | Column, extend: bool = False) -> Column:
    """0 -> 'Day 1', 1 -> 'Day 2'; other days are NULL unless ``extend``."""
    d = col(day)
    if extend:
        return F.when(d.isNotNull(), F.concat(F.lit("Day "), (d + 1).cast("string")))
    return F.when(d == 0, F.lit("Day 1")).when(d == 1, F.lit("Day 2"))


def is_daytime(hour: str | Column, start: int = 8, end: int = 20) -> Column:
    """1 when start <= hour < end."""
    h = col(hour)
    return ((h >= start) & (h < end)).cast("int")


def clip(c: str | Column, lower: float | Column | None = None, upper: float | Column | None = None) -> Column:
    """Winsorise to [lower, upper]; NULL stays NULL (least/greatest would skip it)."""
    x = col(c)
    y = x
    if lower is not None:
        y = F.greatest(y, lower if isinstance(lower, Column) else F.lit(float(lower)))
    if upper is not None:
        y = F.least(y, upper if isinstance(upper, Column) else F.lit(float(upper)))
    return F.when(x.isNotNull(), y)


def pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


# ---------------------------------------------------------------------------
# Amount bands (PR-12 / PR-13)
# ---------------------------------------------------------------------------

# Fixed values that must equal the reference: right-closed band edges and the
# band names, in band order.
BAND_EDGES = (-0.01, 0.0, 10.0, 50.0, 100.0, 500.0, 1000.0, float("inf"))
BAND_NAMES = ("zero", "micro", "small", "medium", "large", "xlarge", "xxlarge")
# Display labels used by the interactive report, same order.
BAND_DISPLAY = (
    "$0 (zero)",
    "$0-10 (micro)",
    "$10-50 (small)",
    "$50-100 (medium)",
    "$100-500 (large)",
    "$500-1K (xlarge)",
    "$1K+ (xxlarge)",
)


@dataclass(frozen=True)
class Bands:
    """Right-closed bands ``(e[i], e[i+1]]``; values <= e[0] or NULL get no band."""

    edges: tuple[float, ...] = BAND_EDGES
    names: tuple[str, ...] = BAND_NAMES

    def ordinal(self, x: str | Column) -> Column:
        v = nan_to_null(col(x).cast("double"))
        expr = None
        for i in range(len(self.names)):
            hi = self.edges[i + 1]
            cond = v <= F.lit(hi) if hi != float("inf") else F.lit(True)
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        return F.when(v.isNull() | (v <= F.lit(self.edges[0])), F.lit(None).cast("int")).otherwise(
            expr.otherwise(F.lit(None).cast("int"))
        )

    def name(self, ordinal: str | Column) -> Column:
        o = col(ordinal)
        return F.element_at(F.array(*[F.lit(n) for n in self.names]), o + 1)

    def onehot(self, ordinal: str | Column, prefix: str = "Amount_bin_") -> list[Column]:
        """One int column per band; a missing band gives all zeros."""
        o = col(ordinal)
        return [
            F.coalesce((o == i).cast("int"), F.lit(0)).alias(f"{prefix}{n}")
            for i, n in enumerate(self.names)
        ]


DEFAULT_BANDS = Bands()
DISPLAY_BANDS = Bands(names=BAND_DISPLAY)


def sample_skew(g1: Column, n: Column) -> Column:
    """Population skewness g1 -> sample-adjusted G1 (pandas ``skew``).

    A constant column (g1 undefined) gives 0.0 as in pandas; n < 3 gives NULL.
    """
    nd = n.cast("double")
    adj = F.sqrt(nd * (nd - 1)) / (nd - 2)
    return F.when(n < 3, F.lit(None).cast("double")).otherwise(F.coalesce(g1, F.lit(0.0)) * adj)


def sample_kurt(g2: Column, n: Column) -> Column:
    """Population excess kurtosis g2 -> sample-adjusted G2 (pandas ``kurt``)."""
    nd = n.cast("double")
    g = F.coalesce(g2, F.lit(-3.0))
    val = (nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(g2.isNull(), F.lit(0.0)).otherwise(val)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both are non-NULL; NULL for zero variance.

    ``corr`` raises under ANSI mode for a constant column, so build it from
    population covariance and standard deviations with ``try_divide``.
    """
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    am, bm = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(am, bm), F.stddev_pop(am) * F.stddev_pop(bm))
