"""One call from a configuration to report, rules and redesign options."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegate.config import AnalysisConfig
from casegate.errors import LogNotLoadedError, NoKnockoutsError, RuleLearningError
from casegate.functions.stats import value_ranges
from casegate.lineage import cut_lineage, write_dealt, write_table
from casegate.operators import redesign, splits
from casegate.operators.casetable import case_table, rule_attributes
from casegate.operators.discovery import discover
from casegate.operators.enrich import PREPROCESSORS
from casegate.operators.labels import check_labels, label, label_log
from casegate.operators.learn import LearnSettings, Teacher, boosted_trees, learn_rules, surrogate_rules
from casegate.operators.metrics import available_cases, efforts, report
from casegate.operators.refit import refit_areas
from casegate.operators.rules import (
    Rulesets,
    confidence_warnings,
    low_confidence,
    rule_features,
    rule_metrics,
    rules_table,
    rules_text,
)
from casegate.operators.tuning import DEFAULT_GRIDS, best_settings, grid_scores
from casegate.schema import BY_START, CASE, KO, KO_KEY
from casegate.sources.files import read_log, write_report

ALGORITHMS = ("IREP", "RIPPER", "CATBOOST-RIPPER")


def redesign_options(
    log: DataFrame, effort: DataFrame, rulesets: Rulesets, cases: DataFrame | None, config=AnalysisConfig()
) -> dict[str, DataFrame]:
    """Dependencies, best order, relocation and rule changes of a labelled log."""
    spark = log.sparkSession
    table = rules_table(spark, rulesets)
    known = {r[KO_KEY]: r["effort"] for r in effort.select(KO_KEY, "effort").collect()}
    # A check that never rejects has no effort; it goes last: it weighs more than all others.
    measured = {ko: known[ko] for ko in rulesets if known.get(ko) is not None}
    last = 1.0 + sum(abs(w) for w in measured.values())
    weights = {ko: measured.get(ko, last) for ko in rulesets}
    # a row per rule attribute: read for the order, the places and the report
    found = cut_lineage(redesign.dependencies(log, rule_features(table)))
    needs = redesign.dependency_map(found, sorted(rulesets))
    best = redesign.optimal_order(spark, weights, needs, config.disallowed_permutations)
    order = redesign.order_or_raise(best)
    options = {
        "dependencies": redesign.dependency_report(found, sorted(rulesets)),
        "reordering": best,
        "cases_following": redesign.cases_following(log, order),
        "relocation": redesign.relocation(
            log, order, needs, config.start_activity, config.relocation_variants_min_coverage_percentage
        ),
    }
    total = log.agg(F.count_distinct(CASE)).scalar()
    options["relocation_report"] = redesign.relocation_report(options["relocation"], total)
    if cases is not None:
        ranges = value_ranges(cases, table, cases.columns)
        options["rule_change"] = redesign.rule_change(rules_text(table), ranges)
        options["rule_change_report"] = redesign.rule_change_report(rules_text(table), ranges)
    return options


@dataclass
class Result:
    """What an analysis found; tables are lazy, rules are a small model."""

    log: DataFrame
    labels: DataFrame
    kos: list[str]
    cases: DataFrame
    rulesets: Mapping[str, list]
    settings: Mapping[str, LearnSettings]
    teachers: Mapping[str, Teacher]
    metrics: DataFrame
    report: DataFrame
    warnings: DataFrame
    redesign: Mapping[str, DataFrame]


class Analysis:
    """Discover, label, learn, measure and advise."""

    def __init__(self, config: AnalysisConfig):
        self.config = config

    def with_options(self, **changes) -> "Analysis":
        """The same analysis with some options changed; nothing is run yet."""
        return Analysis(replace(self.config, **changes))

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.config.log_path:
            raise LogNotLoadedError("the configuration names no log")
        return read_log(spark, self.config)

    def learn(self, cases: DataFrame, kos: list[str], features: list[str]):
        config = self.config
        settings = LearnSettings(
            max_rules=config.max_rules,
            max_rule_conds=config.max_rule_conds,
            max_total_conds=config.max_total_conds,
            k=config.k,
            n_discretize_bins=config.n_discretize_bins,
            dl_allowance=config.dl_allowance,
            prune_size=config.prune_size,
        )
        algorithm = config.rule_discovery_algorithm
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown rule algorithm {algorithm!r}")
        if config.skip_temporal_holdout:
            split = splits.stratified_holdout(cases, F.col(KO))
        else:
            split = splits.temporal_holdout(cases)
        split = write_table(split)
        train, test = split.filter(~F.col("is_test")), split.filter("is_test")
        rulesets: dict[str, list] = {}
        teachers: dict[str, Teacher] = {}
        chosen = {ko: settings for ko in kos}
        base = "IREP" if algorithm == "IREP" else "RIPPER"
        if config.grid_search and algorithm != "CATBOOST-RIPPER":
            grid = config.param_grid or DEFAULT_GRIDS[base]
            try:
                scores = grid_scores(
                    train, kos, features, base, grid, settings, time_aware=not config.skip_temporal_holdout
                )
                chosen |= best_settings(scores, settings)
            except (PySparkException, RuleLearningError, ArithmeticError, LookupError, ValueError) as error:
                warnings.warn(f"grid search failed, the given settings are used: {error}", stacklevel=2)
        # Checks with the same settings learn together; balanced ones each on a sample.
        for tried in dict.fromkeys(chosen.values()):
            group = [ko for ko in kos if chosen[ko] == tried]
            if config.balance_classes and config.skip_temporal_holdout:
                for ko in group:
                    sample = splits.balance_classes(train, F.col(KO).eqNullSafe(ko))
                    rulesets |= self.fit(sample, [ko], features, algorithm, tried, teachers, test)
            else:
                rulesets |= self.fit(train, group, features, algorithm, tried, teachers, test)
        return rulesets, chosen, teachers, test

    def fit(self, train, kos, features, algorithm, settings, teachers, test):
        if algorithm == "CATBOOST-RIPPER":
            config = self.config
            teacher = partial(boosted_trees, iterations=config.teacher_iterations, depth=config.teacher_depth)
            found, fitted = surrogate_rules(train, kos, features, settings, teacher, test)
            teachers |= fitted
            return found
        return learn_rules(train, kos, features, algorithm, settings)

    def areas(self, cases: DataFrame, chosen: Mapping[str, LearnSettings], features: list[str]) -> DataFrame | None:
        """ROC areas of rules learnt again per fold (a teacher's rules: from the labels themselves)."""
        config = self.config
        if not config.roc_folds:
            return None
        base = "IREP" if config.rule_discovery_algorithm == "IREP" else "RIPPER"
        return refit_areas(cases, chosen, features, base, config.roc_folds, not config.skip_temporal_holdout)

    def run(self, log: DataFrame, dealt: int | None = None) -> Result:
        """Analyse a canonical log with boundary events.  ``dealt``: into how many tasks it is hash partitioned
        by case, if it is."""
        config = self.config
        log = write_dealt(log, dealt, CASE, BY_START) if dealt else write_table(log)
        found = discover(log, config)
        labels = label(log, found.kos, config)
        labels = write_dealt(labels, dealt, CASE) if dealt else write_table(labels)
        kos = check_labels(labels)
        if not kos:
            raise NoKnockoutsError("no check rejects a case")
        labelled = label_log(log, labels)
        step = config.custom_log_preprocessing_function
        if step is not None:
            labelled = labelled.transform(PREPROCESSORS[step] if isinstance(step, str) else step)
        labelled = write_dealt(labelled, dealt, CASE, BY_START) if dealt and step is None else write_table(labelled)

        wanted = (config.attributes_to_ignore, config.attributes_to_consider)
        cases = case_table(labelled, labels, *wanted)
        features = rule_attributes(cases.columns, *wanted)
        rulesets, chosen, teachers, test = self.learn(cases, kos, features)
        measures = write_table(
            rule_metrics(
                cases,
                test,
                rulesets,
                available_cases(labelled, kos),
                settings={ko: asdict(own) for ko, own in chosen.items()},
                areas=self.areas(cases, chosen, features),
            )
        )
        low_rules = confidence_warnings(measures, config.confidence_threshold)
        if config.drop_low_confidence_rules:
            low = low_confidence(measures, config.confidence_threshold, config.support_threshold)
            dropped = {r[KO_KEY] for r in low.collect()}
            kos = [ko for ko in kos if ko not in dropped]
            rulesets = {ko: rules for ko, rules in rulesets.items() if ko not in dropped}

        one_timestamp = config.read_options.one_timestamp
        texts = rules_text(rules_table(log.sparkSession, rulesets))
        numbers = report(
            labelled, labels, kos, texts, one_timestamp, config.skip_slow_time_waste_metrics
        )
        effort = efforts(labelled, labels, kos, one_timestamp)
        options = redesign_options(labelled, effort, rulesets, cases, config) if kos else {}
        if config.output:
            write_report(numbers, f"{config.output}/ko_analysis_report")
        return Result(
            labelled, labels, kos, cases, rulesets, chosen, teachers, measures, numbers, low_rules, options
        )
