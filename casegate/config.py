"""Settings of an analysis.  The field names are fixed values: the format of configuration files."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame

from casegate.errors import UnsupportedFileError


def as_list(value) -> list:
    """A list, from a list, a comma-separated text or nothing."""
    if not value:
        return []
    if isinstance(value, str):
        return [part.strip() for part in value.split(",")]
    return list(value)


@dataclass(frozen=True)
class ReadOptions:
    column_names: Mapping[str, str] | None = None
    timestamp_format: str = "%Y-%m-%dT%H:%M:%S.%f"
    one_timestamp: bool = False
    filter_d_attrib: bool = False
    split_lines: bool = False


@dataclass(frozen=True)
class AnalysisConfig:
    """Options of discovery, rule learning, redesign and reading.

    Change one with ``dataclasses.replace``; the plan is rebuilt on the next run.
    """

    log_path: str | None = None
    output: str | None = None

    post_knockout_activities: list[str] = field(default_factory=list)
    success_activities: list[str] = field(default_factory=list)
    known_ko_activities: list[str] = field(default_factory=list)
    start_activity: str = "Start"
    end_activity: str = "End"
    exclude_from_ko_activities: list[str] = field(default_factory=list)
    ko_count_threshold: int | None = None
    attributes_to_ignore: list[str] = field(default_factory=list)
    attributes_to_consider: list[str] | None = None

    rule_discovery_algorithm: str = "RIPPER"
    confidence_threshold: float = 0.5
    support_threshold: float | None = None
    drop_low_confidence_rules: bool = False
    grid_search: bool = False
    param_grid: Mapping[str, list] | None = None
    max_rules: int | None = None
    max_rule_conds: int | None = None
    max_total_conds: int | None = None
    k: int = 2
    n_discretize_bins: int = 10
    dl_allowance: float = 1
    prune_size: float = 0.8
    #: Depth (up to 16) and number of the teacher's trees, for CATBOOST-RIPPER.
    teacher_depth: int = 5
    teacher_iterations: int = 10
    #: Folds that rules are learnt again for, to measure their ROC area; 0: the held-out cases alone.
    roc_folds: int = 0
    skip_temporal_holdout: bool = False
    balance_classes: bool = False
    custom_log_preprocessing_function: str | Callable[[DataFrame], DataFrame] | None = None

    disallowed_permutations: list[list[str]] = field(default_factory=list)
    relocation_variants_min_coverage_percentage: float = 0.001
    skip_slow_time_waste_metrics: bool = False

    read_options: ReadOptions = field(default_factory=ReadOptions)

    @staticmethod
    def from_dict(data: Mapping) -> "AnalysisConfig":
        """From JSON-like data; keys that only concern files and caches are left out."""
        known = {f.name for f in fields(AnalysisConfig)}
        values = {k: v for k, v in data.items() if k in known and v is not None}
        for name in (
            "post_knockout_activities",
            "success_activities",
            "known_ko_activities",
            "exclude_from_ko_activities",
            "attributes_to_ignore",
            "disallowed_permutations",
        ):
            values[name] = as_list(values.get(name))
        if not values.get("ko_count_threshold"):
            values.pop("ko_count_threshold", None)
        if "read_options" in values:
            values["read_options"] = ReadOptions(**values["read_options"])
        return AnalysisConfig(**values)

    @staticmethod
    def from_json(path: str) -> "AnalysisConfig":
        if not path.endswith(".json"):
            raise UnsupportedFileError("configuration files must be .json")
        with open(path, encoding="utf-8") as source:
            return AnalysisConfig.from_dict(json.load(source))
