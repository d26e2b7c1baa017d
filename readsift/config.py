"""Settings passed to operators as arguments, never read as globals."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# Feature groups of the read-exception frame.
CATEGORICAL_COLUMNS = (
    "LOCATION_CLASS",
    "YEAR", "MONTH", "DAY", "DOW",
    "PREVYEAR", "PREVMONTH", "PREVDAY", "PREVDOW", "PREV_UOM",
    "PREVPREVYEAR", "PREVPREVMONTH", "PREVPREVDAY", "PREVPREVDOW", "PREVPREV_UOM",
    "UOM",
    "PREV_STATUS", "PREV_STATUS2",
    "NEXTYEAR", "NEXTMONTH", "NEXTDAY", "NEXTDOW", "NEXT_UOM", "NEXT_STATUS",
    "METER_TP",
    "READ_HR", "READ_MIN", "READ_SECOND",
)
NUMERICAL_COLUMNS = ("READ_VALUE", "PREV_READ", "PREV_READ2", "NEXT_READ_VALUE")
BINARY_COLUMNS = ("HILO", "REGISTERINCREASING", "SUMCHECK", "MAXDAILYUSAGE")
TARGET_COLUMN = "Status"
DATE_COLUMN = "Date"
CLASSES = (1, 0)

# Warehouse status codes, comment marks and date cut-off.
STATUS_NORMAL = 1
STATUS_FAILED = 2
STATUS_ACCEPTED = 5
FIRST_READ_VERSION = 1
AUTOMATIC_MARK = "Automatically"
ACCEPTED_MARK = "Accepted"
RULE_MARKS = (
    ("HILO", "HiLo:"),
    ("REGISTERINCREASING", "RegisterIncreasing:"),
    ("SUMCHECK", "SumCheck:"),
    ("MAXDAILYUSAGE", "MaxDailyUsage:"),
)
DEFAULT_SINCE = datetime(2019, 1, 1)


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns of a frame play which role in encoding."""

    categorical: tuple[str, ...] = CATEGORICAL_COLUMNS
    numerical: tuple[str, ...] = NUMERICAL_COLUMNS
    passthrough: tuple[str, ...] = BINARY_COLUMNS
    label: str = TARGET_COLUMN

    @property
    def features(self) -> tuple[str, ...]:
        return self.categorical + self.numerical + self.passthrough


@dataclass(frozen=True)
class Experiment:
    """Settings of a training and evaluation run; the ``do_`` fields switch its parts."""

    seed: int = 0
    train_share: float = 0.8
    folds: int = 10
    repeats: int = 10
    repeated: bool = False
    time_series: bool = True
    expanding: bool = True
    calibration_bins: int = 10
    calibration_method: str = "isotonic"
    metrics: tuple[str, ...] = ("accuracy",)
    train_scores: bool = True
    shuffle_targets: bool = False
    curve_steps: int = 20
    do_learning_curve: bool = True
    do_cross_validation: bool = True
    do_validation_curve: bool = False
    do_tuning: bool = False
    tuned: tuple[str, ...] = ("neighbours", "tree", "logit")
    do_learning_analysis: bool = False
    do_calibrated_validation: bool = False
    do_calibration: bool = False
    do_pooled_confusion: bool = False
    do_test_set: bool = False
    spec: FeatureSpec = field(default_factory=FeatureSpec)
