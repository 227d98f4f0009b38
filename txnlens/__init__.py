"""txnlens: Spark-native analytics for labelled transaction tables with a rare positive class.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
built-in Spark SQL expressions; results stay distributed until the caller acts.
"""

from txnlens.spec import TxnSpec

__all__ = ["TxnSpec"]
