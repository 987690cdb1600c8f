"""pagefleet — route and telemetry analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns); nothing is
collected to the driver inside an operator.
"""

from pagefleet.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
