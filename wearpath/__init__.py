"""wearpath: run-to-failure analytics on PySpark DataFrames."""

from wearpath.spec import TelemetrySpec

__all__ = ["TelemetrySpec"]
