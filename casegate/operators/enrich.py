"""Attributes planted into a labelled log, and masks for when they become known."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.schema import ACTIVITY, CASE, END_TS, KO, START_TS

# Fixed values of the synthetic credit process: what every case starts with.
BASE_VALUES = {
    "Monthly Income": 1500.0,
    "Total Debt": 4000.0,
    "Loan Ammount": 9000.0,
    "Owns Vehicle": True,
    "Demographic": "demographic_type_1",
    "External Risk Score": 0.1,
    "Aggregated Risk Score": 0.2,
}

# Fixed values of the cases each check rejects.  Check Liability rejects for one of
# two reasons, each for about half of its cases.
REJECTED_VALUES = {
    "Check Liability": ({"Total Debt": 5000.0}, {"Owns Vehicle": False}),
    "Check Risk": ({"Loan Ammount": 15000.0},),
    "Check Monthly Income": ({"Monthly Income": 800.0},),
    "Assess application": ({"External Risk Score": 0.4},),
    "Aggregated Risk Score Check": ({"Aggregated Risk Score": 0.6},),
}


def fixed_attributes(
    log: DataFrame,
    base: Mapping[str, object] = BASE_VALUES,
    rejected: Mapping[str, Sequence[Mapping[str, object]]] = REJECTED_VALUES,
) -> DataFrame:
    """Case attributes by label.  Where a check has several reasons, the case id's
    hash picks one."""
    added: dict[str, Column] = {}
    draw = F.conv(F.substring(F.md5(CASE), 1, 4), 16, 10).cast("long")
    for name, value in base.items():
        column = F.lit(value)
        for ko, reasons in rejected.items():
            for i, reason in enumerate(reasons):
                if name in reason:
                    chosen = (F.col(KO) == ko) & (draw % len(reasons) == i)
                    column = F.when(chosen, F.lit(reason[name])).otherwise(column)
        added[name] = column
    return log.withColumns(added)


def mask_until(log: DataFrame, providers: Mapping[str, str]) -> DataFrame:
    """Null each attribute at events that start before its provider activity first
    completed; cases without the provider are left alone.  ``providers`` maps
    attribute to activity."""
    activities = sorted(set(providers.values()))
    done = (
        log.filter(F.col(ACTIVITY).isin(*activities))
        .groupBy(CASE)
        .agg(
            *[
                F.min_by(END_TS, F.when(F.col(ACTIVITY) == a, F.struct(START_TS, "seq"))).alias(f"_done{i}")
                for i, a in enumerate(activities)
            ]
        )
    )
    masked = {}
    for attribute, provider in providers.items():
        known = F.col(f"_done{activities.index(provider)}")
        masked[attribute] = F.when(known.isNull() | (F.col(START_TS) >= known), F.col(f"`{attribute}`"))
    return log.join(done, CASE, "left").withColumns(masked).select(*[f"`{c}`" for c in log.columns])


Preprocessor = Callable[[DataFrame], DataFrame]

PREPROCESSORS: dict[str, Preprocessor] = {}


def preprocessor(name: str) -> Callable[[Preprocessor], Preprocessor]:
    """Decorator: register a log preprocessing step under a name for configurations."""

    def add(step: Preprocessor) -> Preprocessor:
        PREPROCESSORS[name] = step
        return step

    return add


@preprocessor("enrich_log_with_fully_known_attributes")
def fully_known(log: DataFrame) -> DataFrame:
    return fixed_attributes(log)


@preprocessor("enrich_log_with_fully_known_attributes_fixed_values_wrapper")
def fully_known_fixed(log: DataFrame) -> DataFrame:
    return fixed_attributes(log)


@preprocessor("enrich_log_for_ko_order_advanced_test")
def aggregated_score_after_risk(log: DataFrame) -> DataFrame:
    return mask_until(fixed_attributes(log), {"Aggregated Risk Score": "Check Risk"})


@preprocessor("enrich_log_for_ko_order_advanced_test_fixed_values_wrapper")
def aggregated_score_after_risk_fixed(log: DataFrame) -> DataFrame:
    return mask_until(fixed_attributes(log), {"Aggregated Risk Score": "Check Risk"})


@preprocessor("enrich_log_for_synthetic_example_validation")
def external_score_after_risk(log: DataFrame) -> DataFrame:
    return mask_until(fixed_attributes(log), {"External Risk Score": "Check Risk"})
