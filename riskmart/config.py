"""Parameters of a run. Every value is plain data; sessions belong to the caller."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Defaults that decide results or where data is found.
PREDICTION_MONTHS = 1
LABEL_WINDOW_MONTHS = 12
MAX_LOAN_MONTHS = 12
TEST_LAST_N_MONTHS = 3
RAW_FILES = {
    "financials": "data/features_financials.csv",
    "attributes": "data/features_attributes.csv",
    "loan_daily": "data/lms_loan_daily.csv",
    "clickstream": "data/feature_clickstream.csv",
}
BRONZE_PATH = "datamart/bronze"
SILVER_PATH = "datamart/silver"
GOLD_PATH = "datamart/gold"
LABEL_STORE_PATH = "datamart/label_store"
MODEL_PATH = "model_store"
WORK_PATH = "work"

GRAINS = ("customer", "loan")
HISTORY_ENDS = ("inclusive", "exclusive")
RAW_MODES = ("batch", "mirror")
MEDIANS = ("approximate", "exact")

# Session settings the plans rely on. Adaptive execution is on by default.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


@dataclass(frozen=True)
class Config:
    """Paths and parameters of the bronze → silver → gold → model run.

    Paths may be any URI the cluster's Hadoop file systems understand; all of them, ``work_path`` for intermediate
    tables included, must be visible to every executor. ``multi_line`` names the sources whose fields hold line breaks, ``column_types``
    declares columns by source and name that the schemas do not, and ``exclude`` keeps columns out of the features. With ``raw_mode`` batch a raw file
    replaces the months that it has; as mirror, bronze follows the raw files, also when they change or go. ``median`` says how missing numbers are filled.
    """

    raw_paths: Mapping[str, str]
    bronze_path: str = BRONZE_PATH
    silver_path: str = SILVER_PATH
    label_path: str = LABEL_STORE_PATH
    gold_path: str = GOLD_PATH
    model_path: str = MODEL_PATH
    work_path: str = WORK_PATH
    prediction_months: int = PREDICTION_MONTHS
    label_window_months: int = LABEL_WINDOW_MONTHS
    max_loan_months: int = MAX_LOAN_MONTHS
    test_last_n_months: int = TEST_LAST_N_MONTHS
    grain: str = "customer"
    history_end: str = "inclusive"
    plural_only: bool = True
    exclude: tuple[str, ...] = ()
    multi_line: Mapping[str, bool] = field(default_factory=dict)
    column_types: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    raw_mode: str = "batch"
    median: str = "approximate"

    def __post_init__(self) -> None:
        if self.grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}, not {self.grain!r}")
        if self.history_end not in HISTORY_ENDS:
            raise ValueError(f"history_end must be one of {HISTORY_ENDS}, not {self.history_end!r}")
        if self.median not in MEDIANS:
            raise ValueError(f"median must be one of {MEDIANS}, not {self.median!r}")
        if self.raw_mode not in RAW_MODES:
            raise ValueError(f"raw_mode must be one of {RAW_MODES}, not {self.raw_mode!r}")

    @classmethod
    def under(cls, root: str, **changes) -> Config:
        """The default layout below ``root``."""
        base = root.rstrip("/")
        paths = {
            "raw_paths": {name: f"{base}/{file}" for name, file in RAW_FILES.items()},
            "bronze_path": f"{base}/{BRONZE_PATH}",
            "silver_path": f"{base}/{SILVER_PATH}",
            "label_path": f"{base}/{LABEL_STORE_PATH}",
            "gold_path": f"{base}/{GOLD_PATH}",
            "model_path": f"{base}/{MODEL_PATH}",
            "work_path": f"{base}/{WORK_PATH}",
        }
        return cls(**{**paths, **changes})
