"""Label groups and dataset profiles (driver-side configuration)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Label ids and their meanings in the two label domains.
QC_FLAG_MEANINGS = {
    0: "no QC",
    1: "good",
    2: "probably good",
    3: "probably bad",
    4: "bad",
    6: "bad down-sampling",
    7: "averaged",
    8: "interpolated",
    9: "missing / NaN",
}
PLUG_LABEL_MEANINGS = {
    0: "good",
    1: "conductivity bad plug",
    2: "conductivity bad other",
    3: "non-conductivity failure",
    4: "missing data",
}

# File-name markers of the device families, in merge order.
DEVICE_MARKERS = {
    "ctd": "ConductivityTemperatureDepth",
    "fluorometer": "Fluorometer",
    "oxygen": "OxygenSensor",
}
MERGE_ORDER = ("ctd", "fluorometer", "oxygen", "other")


@dataclass(frozen=True)
class Profile:
    """Which columns hold the label and the measurements, and what labels mean."""

    target: str = "qc"
    measurements: tuple[str, ...] = ("m1", "m2", "m3")
    good: tuple[int, ...] = (1,)
    issue: tuple[int, ...] = (3, 4, 9)
    task: str = "multiclass"
    time: str = "ts"
    source: str = "source_file"
    tie_break: tuple[str, ...] = ("row_id",)
    meanings: dict[int, str] = field(default_factory=lambda: dict(QC_FLAG_MEANINGS))

    @property
    def reviewed(self) -> tuple[int, ...]:
        return tuple(dict.fromkeys([*self.good, *self.issue]))

    @property
    def source_order(self) -> list[str]:
        """Order inside one source."""
        return [self.time, *self.tie_break]

    @property
    def global_order(self) -> list[str]:
        """Order over all sources."""
        return [self.time, self.source, *self.tie_break]


def fractional_row_limit(row_count: int, fraction: float) -> int | None:
    """Row limit for a share of the data; no limit from 0.999 upwards."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    if fraction >= 0.999:
        return None
    return min(row_count, max(1, round(row_count * fraction)))


def scaled_cap(cap: int, fraction: float, floor: int) -> int:
    """A cap scaled with the data share, never below its floor."""
    return max(floor, int(cap * fraction))
