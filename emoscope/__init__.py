"""emoscope: corpus preparation and evaluation analytics on Spark.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column) built on Spark SQL expressions, windows and joins, so Catalyst plans
it and the cluster scales it.  Sub-packages:

- ``sources``    readers and writers (SRC*, SNK*)
- ``functions``  column functions: names, text, arrays (PRJ*, ARR*)
- ``operators``  table operators: filters, joins, metrics, windows, splits
- ``plans``      views over the driver tables and the registered queries
- ``streaming``  Structured Streaming variants (STR*)
"""

from emoscope.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
