"""Shape of a telemetry table: which columns are key, time, settings and sensors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from wearpath.functions.names import numbered


@dataclass(frozen=True)
class TelemetrySpec:
    """Column roles of a unit-by-cycle table.

    ``unit`` names the key columns of one unit: ``("id",)`` for a single data set,
    ``("dataset", "id")`` where several sets share one table.
    """

    unit: tuple[str, ...] = ("id",)
    time: str = "cycle"
    settings: tuple[str, ...] = field(default_factory=lambda: numbered("setting", 3))
    sensors: tuple[str, ...] = field(default_factory=lambda: numbered("s", 21))

    @property
    def key(self) -> list[str]:
        return [*self.unit, self.time]

    @property
    def measures(self) -> list[str]:
        return [*self.settings, *self.sensors]

    def with_dataset(self, column: str = "dataset") -> TelemetrySpec:
        return self if column in self.unit else replace(self, unit=(column, *self.unit))

    def schema(self) -> T.StructType:
        """Schema of a telemetry text file (a ``dataset`` key is not part of the file)."""
        keys = [c for c in self.key if c != "dataset"]
        return T.StructType(
            [T.StructField(c, T.IntegerType(), False) for c in keys]
            + [T.StructField(c, T.DoubleType(), True) for c in self.measures]
        )


#: The turbofan layout: 3 settings, 21 sensors.
TURBOFAN = TelemetrySpec()
#: The same layout with the older spelling of the time column.
TURBOFAN_CYKLE = TelemetrySpec(time="cykle")

#: Remaining life after the last observed cycle, one row per unit.
TRUTH_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("RUL_at_maxcycle", T.IntegerType(), False),
    ]
)

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("user", T.IntegerType()),
        T.StructField("item", T.IntegerType()),
        T.StructField("rating", T.FloatType()),
    ]
)
