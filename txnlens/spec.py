"""Column-role description shared by all operators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


@dataclass(frozen=True)
class TxnSpec:
    """Names of the columns that play a role in the analysis.

    Column names are parameters everywhere; these defaults describe the
    reference table (event time in seconds, amount, 0/1 label, V1..V28).
    """

    time: str = "Time"
    amount: str = "Amount"
    label: str = "Class"
    key: str | None = "txn_id"
    feature_pattern: str = r"V\d+"
    prefix: str = "V"  # engineered feature columns begin with it as well
    extra_exclude: tuple[str, ...] = field(default_factory=tuple)

    def features(self, df: DataFrame) -> list[str]:
        """Numbered feature columns (``V1``..``V28``) in table order."""
        pat = re.compile(self.feature_pattern)
        return [c for c in df.columns if pat.fullmatch(c)]

    def numeric(self, df: DataFrame, include_label: bool = True) -> list[str]:
        """Numeric columns in table order, without the key column."""
        skip = {self.key, *self.extra_exclude} - {None}
        if not include_label:
            skip.add(self.label)
        return [
            n for n, t in df.dtypes if n not in skip and t.split("(")[0] in _NUMERIC
        ]
