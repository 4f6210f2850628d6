"""ledgerlens: Spark-native internal-audit analytics over purchase data.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql`` expressions, so Catalyst plans it and the work runs on the
executors.  Nothing is collected to the driver inside an operator.
"""

from ledgerlens.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
