"""plantlens: Spark-native analytics for factory and machine logs.

Every operator is a ``DataFrame -> DataFrame`` function (composable with
``df.transform``) built from Spark SQL expressions, grouping sets, windows
and Spark ML.  No Python UDF runs in any operator.
"""

from plantlens.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
