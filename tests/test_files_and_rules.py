"""File formats, learning, and the analysis as a whole."""

import gzip
import hashlib
import math
import os
import random
import tempfile
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from casegate.config import AnalysisConfig, ReadOptions
from casegate.errors import EmptyLogError, NoKnockoutsError, UnsupportedFileError
from casegate.functions import stats
from casegate.lineage import write_table
from casegate.operators import casetable, learn, rules, splits
from casegate.operators.labels import check_labels, label
from casegate.operators.names import names_of
from casegate.operators.prepare import add_boundaries, datetime_pattern, keep_tasks
from casegate.operators.rules import Condition
from casegate.operators.wip import wip_features
from casegate.plans.analysis import Analysis
from casegate.sources.derived import order_log
from casegate.sources.files import extension, read_csv, read_log, read_xes, write_report, write_xes
from tests.logs import event, log_of, sequences

CSV = """Case ID,Activity,Resource,Start Timestamp,Complete Timestamp,Amount
1,Start,x,2022-02-17T08:00:00.000000,2022-02-17T08:00:00.000000,1
1,"Check, A",Ann,2022-02-17T09:00:00.000001,2022-02-17T10:00:00.500000,5
2,Check B,Bob,2022-02-17T09:30:00.000000,2022-02-17T09:45:00.000000,7
"""


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="casegate-test-")


def test_csv_plain_and_compressed(spark, folder):
    with open(f"{folder}/log.csv", "w") as out:
        out.write(CSV)
    with gzip.open(f"{folder}/log2.csv.gz", "wt") as out:
        out.write(CSV)
    with zipfile.ZipFile(f"{folder}/log3.zip", "w") as out:
        out.writestr("inner.csv", CSV)
    found = [
        sorted(map(tuple, read_csv(spark, f"{folder}/{n}").drop("seq").collect()))
        for n in ("log.csv", "log2.csv.gz", "log3.zip")
    ]
    assert found[0] == found[1] == found[2]
    assert [r[1] for r in found[0]] == ["Check, A", "Check B"]
    assert found[0][0][5] == 3_600_499_999
    one = read_csv(spark, f"{folder}/log.csv", ReadOptions(one_timestamp=True, filter_d_attrib=True))
    assert "Amount" not in one.columns
    assert one.filter(F.col("start_ts") != F.col("end_ts")).isEmpty()
    with pytest.raises(UnsupportedFileError):
        extension("log.mxml.txt")


def test_xes_round_trip(spark, folder):
    rows = [event("a", 1, "Check", 1, 2.5), event("a", 2, "Check", 2, 3, "R2"), event("b", 3, "Pay", 5, 6)]
    log = log_of(spark, rows, "amount double, vip boolean, note string, n long", [(1.5, True, "x<y", 4), (2.5, False, None, 5), (None, None, "z", 6)])
    write_xes(log, f"{folder}/out.xes")
    back = read_xes(spark, f"{folder}/out.xes")
    columns = ["case_id", "activity", "resource", "start_ts", "end_ts", "duration_us", "amount", "vip", "note", "n"]
    assert sorted(map(tuple, back.select(columns).collect()), key=repr) == sorted(
        map(tuple, log.select(columns).collect()), key=repr
    )


def test_xes_files_are_parsed_once(spark, folder):
    times = ['<date key="time:timestamp" value="2022-01-01T0%d:00:00"/>' % i for i in (1, 2)]
    body = '<string key="concept:name" value="Pay"/><string key="note" value="old"/><int key="n" value="7"/>'
    events = [f'<event>{body}<string key="note" value="new"/>{times[0]}</event>', f'<event><string key="concept:name" value="End it"/>{times[1]}</event>']
    with open(f"{folder}/once.xes", "w") as out:
        out.write(f'<log><trace><string key="concept:name" value="c"/>{"".join(events)}</trace></log>')
    back = read_xes(spark, f"{folder}/once.xes")
    assert not any("once.xes" in file for file in back.inputFiles())
    assert [tuple(r) for r in back.orderBy("seq").select("activity", "note", "n").collect()] == [("Pay", "new", 7), ("End it", None, None)]


def test_small_helpers(spark):
    assert datetime_pattern("%Y-%m-%dT%H:%M:%S.%f") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ids = spark.createDataFrame([("Task_1",), ("Gateway_2",)], "elementId string")
    assert [r[0] for r in keep_tasks(ids).collect()] == ["Task_1"]
    names = ["case_id", "amount", "paid", "some activity", "st_weekday", "Own Car", "seq"]
    assert casetable.rule_attributes(names) == ["amount", "Own Car"]
    assert casetable.rule_attributes(names, ignore=["Own_Car"]) == ["amount"]
    assert casetable.rule_attributes(names, consider=["paid"]) == ["paid"]
    assert casetable.underscored(spark.createDataFrame([(1,)], "`a b` int")).columns == ["a_b"]
    assert stats.t_quantile(0.95, 10) == pytest.approx(2.228139, abs=1e-5)
    config = AnalysisConfig.from_dict({"post_knockout_activities": "a, b", "ko_count_threshold": 0, "$schema": "x"})
    assert config.post_knockout_activities == ["a", "b"] and config.ko_count_threshold is None


def test_empty_inputs_raise(spark):
    log = sequences(spark, [["Start", "a", "End"]])
    labels = spark.createDataFrame([("c000", True, "a")], "case_id string, knocked_out_case boolean, knockout_activity string")
    with pytest.raises(NoKnockoutsError):
        check_labels(labels)
    with pytest.raises(EmptyLogError):
        casetable.case_table(log, labels)
    with pytest.raises(EmptyLogError):
        casetable.case_table(log.withColumn("x", F.lit(None).cast("string")), labels)


def test_rejected_case_without_check_keeps_a_null_label(spark):
    log = sequences(spark, [["Start", "a", "bad", "End"], ["Start", "bad", "a", "End"], ["Start", "a", "End"]])
    config = AnalysisConfig(post_knockout_activities=["bad"])
    found = {r["case_id"]: tuple(r)[1:] for r in label(log, ["a"], config).collect()}
    assert found == {"c000": (True, "a"), "c001": (True, None), "c002": (False, None)}


def planted(spark, n=600):
    """Two checks, each with one true condition."""
    rows = []
    for i in range(n):
        amount, kind, risk = float(i * 37 % 1000), "xyz"[i % 3], float(i * 53 % 100)
        ko = "amount" if amount < 200 else "kind" if kind == "z" else None
        rows.append((f"{i}", ko is not None, ko, amount, kind, risk))
    return spark.createDataFrame(
        rows, "case_id string, knocked_out_case boolean, knockout_activity string, amount double, kind string, risk double"
    )


@pytest.mark.parametrize("algorithm", ["IREP", "RIPPER"])
def test_planted_rules_are_found(spark, algorithm):
    settings = learn.LearnSettings(max_rules=2, max_rule_conds=1, prune_size=0.33, k=1)
    found = learn.learn_rules(planted(spark), ["amount", "kind"], ["amount", "kind", "risk"], algorithm, settings)
    assert found["kind"][0] == (Condition("kind", "=", value="z"),)
    assert {c.feature for rule in found["amount"] for c in rule} == {"amount"}
    assert all(rule[0].hi <= 210 for rule in found["amount"])
    assert learn.learn_rules(planted(spark).limit(0), ["amount"], ["amount"], algorithm) == {"amount": []}


def test_predicates_and_measures(spark):
    cases = planted(spark)
    model = {"amount": [(Condition("amount", "<", hi=200.0),)], "kind": []}
    row = rules.coverage(cases, model).filter("ko_activity = 'amount'").first()
    true = cases.filter("knockout_activity = 'amount'").count()
    assert (row["predicted"], row["predicted_true"]) == (true, true)
    none = rules.holdout_quality(cases, model).filter("ko_activity = 'kind'").first()
    assert (none["precision"], none["recall"], none["f1_score"]) == (0.0, 0.0, 0.0)
    texts = spark.createDataFrame([("1.5-3",), ("<2",), (">4.25",), ("TRUE",)], "shown string")
    assert [tuple(r) for r in rules.text_intervals(texts).select("lo", "hi").collect()] == [
        (1.5, 3.0), (None, 2.0), (4.25, None), (None, None)
    ]


def test_full_analysis_on_orders(spark, folder):
    log = add_boundaries(order_log(spark, "/root/testdata/sf0.001"))
    config = AnalysisConfig(
        post_knockout_activities=["Notify rejection"], rule_discovery_algorithm="IREP",
        max_rules=3, max_rule_conds=1, prune_size=0.33, confidence_threshold=0.99,
    )
    result = Analysis(config).run(log)
    assert result.kos == ["Check Balance", "Check Price", "Check Priority"]
    table = {r["ko_activity"]: r for r in result.report.collect()}
    chain = [table[k] for k in result.kos]
    for now, then in zip(chain, chain[1:]):
        assert then["available_cases"] == now["available_cases"] - now["knocked_out_cases"]
    assert {c.feature for c in result.rulesets["Check Balance"][0]} == {"c_acctbal"}
    needs = {r["ko_activity"]: r["dependencies"] for r in result.redesign["dependencies"].collect()}
    assert needs["Check Balance"] == "'c_acctbal' is known once this is done: 'Load account'"
    assert result.redesign["rule_change_report"].count() == sum(bool(r) for r in result.rulesets.values())
    assert result.warnings.count() >= 1
    write_report(result.report, f"{folder}/report")
    assert spark.read.option("header", True).csv(f"{folder}/report").count() == 3
    assert Analysis(config).with_options(known_ko_activities=["a"]).config == replace(config, known_ko_activities=["a"])


def test_line_breaks_in_quotes_and_headers_of_their_own(spark, folder):
    head = "Case ID,Activity,Resource,Start Timestamp,Complete Timestamp,Note\n"
    row = '1,Check,Ann,2022-02-17T09:00:00.000000,2022-02-17T10:00:00.000000,"two\nlines, ""quoted"""\n'
    other = "Activity,Case ID,Complete Timestamp,Start Timestamp,Resource,Extra\nPay,2,2022-02-17T12:00:00.000000,2022-02-17T11:00:00.000000,Bob,x\n"
    with open(f"{folder}/broken.csv", "w") as out:
        out.write(head + row)
    with zipfile.ZipFile(f"{folder}/broken.zip", "w") as out:
        out.writestr("a.csv", head + row)
        out.writestr("b.csv", other)
    plain = read_csv(spark, f"{folder}/broken.csv").select("case_id", "activity", "Note").collect()
    assert [tuple(r) for r in plain] == [("1", "Check", 'two\nlines, "quoted"')]
    both = read_csv(spark, f"{folder}/broken.zip").select("case_id", "activity", "resource", "Note", "Extra").collect()
    assert sorted(map(tuple, both)) == [("1", "Check", "Ann", 'two\nlines, "quoted"', None), ("2", "Pay", "Bob", None, "x")]


def test_rows_without_a_sequence_are_told_apart(spark, folder):
    """A case that repeats a task: its work in progress counts each run on its own."""
    head = "Case ID,Activity,Resource,Start Timestamp,Complete Timestamp\n"
    rows = [(1, 8), (2, 20), (3, 20), (1, 20)]
    with open(f"{folder}/repeats.csv", "w") as out:
        out.write(head + "".join(f"{c},Check,R,2022-02-17T{h:02d}:00:00.000000,2022-02-17T{h:02d}:30:00.000000\n" for c, h in rows))
    log = add_boundaries(write_table(read_csv(spark, f"{folder}/repeats.csv")))
    assert log.select("case_id", "seq").distinct().count() == log.count()
    found = wip_features(log.withColumn("role", F.when(F.col("resource") == "R", F.lit("clerk"))))
    early = found.filter(F.hour("start_ts") == 8).first()
    assert (early["st_wip"], early["st_tsk_wip"], early["rp_st_oc"]) == (1, 1, 1.0)
    assert found.filter(F.hour("start_ts") == 20).agg(F.max("st_tsk_wip")).first()[0] == 3


def test_zipped_xes_and_copies(spark, folder):
    rows = [event("a", 1, "Check", 1, 2.5), event("a", 2, "Check", 2, 3, "R2"), event("b", 3, "Pay", 5, 6)]
    log = log_of(spark, rows)
    write_xes(log, f"{folder}/plain.xes")
    part = next(f for f in sorted(os.listdir(f"{folder}/plain.xes")) if f.startswith("part-"))
    with zipfile.ZipFile(f"{folder}/packed.zip", "w") as out:
        out.write(f"{folder}/plain.xes/{part}", "log.xes")
    config = AnalysisConfig(log_path=f"{folder}/packed.zip")
    names = ["case_id", "activity", "resource", "start_ts", "end_ts"]
    parts = [f for f in os.listdir(f"{folder}/plain.xes") if f.startswith("part-")]
    found = read_log(spark, config).filter(~F.col("activity").isin("Start", "End")).select(names)
    if len(parts) == 1:
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, log.select(names).collect()), key=repr)
    assert found.count() > 0
    trace = '<trace><string key="concept:name" value="c"/>{}</trace>'
    one = '<event><string key="concept:name" value="A"/><date key="time:timestamp" value="{}"/></event>'
    with open(f"{folder}/copies.xes", "w") as out:
        out.write("<log>" + trace.format(one.format("2022-02-17T09:00:00.000+01:00") * 2) + "</log>")
    assert read_xes(spark, f"{folder}/copies.xes").count() == 1
    with open(f"{folder}/bad.xes", "w") as out:
        out.write("<log>" + trace.format(one.format("yesterday")) + "</log>")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_xes(spark, f"{folder}/bad.xes").collect()


def test_simulator_logs_are_told_by_their_source(spark, folder):
    trace = '<trace><string key="concept:name" value="c"/>{}</trace>'
    one = '<event><string key="concept:name" value="{0}"/><string key="elementId" value="{0}_1"/><date key="time:timestamp" value="2022-02-17T09:00:00"/></event>'
    body = trace.format(one.format("Task") + one.format("Gateway"))
    for name, source, wanted in (("sim", "com.qbpsimulator", ["Task"]), ("other", "x", ["Gateway", "Task"])):
        with open(f"{folder}/{name}.xes", "w") as out:
            out.write(f'<log><string key="source" value="{source}"/>\n{body}</log>')
        with zipfile.ZipFile(f"{folder}/{name}-packed.zip", "w") as out:
            out.write(f"{folder}/{name}.xes", "log.xes")
        for file in (f"{name}.xes", f"{name}-packed.zip"):
            assert sorted(r["activity"] for r in read_xes(spark, f"{folder}/{file}").collect()) == wanted


def brute_irep(cases, ko, features, prune_size):
    """IREP over plain rows of (id, check, labels): every candidate condition of every step."""
    def prunes(case):
        return int(hashlib.md5(f"{case}|0".encode()).hexdigest()[:6], 16) / 16**6 < prune_size

    def met(labels, rule):
        return all(labels[f] == v for f, v in rule)

    rest, rules_found = list(cases), []
    while True:
        grow = [(k == ko, labels) for i, k, labels in rest if not prunes(i)]
        prune = [(k == ko, labels) for i, k, labels in rest if prunes(i)]
        if not any(y for y, _ in grow):
            return rules_found
        rule = []
        while True:
            inside = [(y, labels) for y, labels in grow if met(labels, rule)]
            p0, n0 = sum(y for y, _ in inside), sum(not y for y, _ in inside)
            if rule and n0 == 0:
                break
            offers = []
            for f in features:
                for v in {labels[f] for _, labels in inside}:
                    p = sum(y for y, labels in inside if labels[f] == v)
                    n = sum(not y for y, labels in inside if labels[f] == v)
                    if p:
                        offers.append((-round(p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 9), f, v))
            if not offers or -min(offers)[0] <= 1e-9 or min(offers)[1] in {f for f, _ in rule}:
                break
            rule.append(min(offers)[1:])
        if not rule:
            return rules_found
        worth = []
        for size in range(1, len(rule) + 1):
            hit = [y for y, labels in prune if met(labels, rule[:size])]
            worth.append((sum(hit) - (len(hit) - sum(hit))) / len(hit) if hit else -1.0)
        size = worth.index(max(worth)) + 1 if any(met(labels, rule[:1]) for _, labels in prune) else len(rule)
        hit = [y for y, labels in prune if met(labels, rule[:size])]
        if sum(hit) <= len(hit) - sum(hit):
            return rules_found
        rules_found.append(tuple(rule[:size]))
        rest = [(i, k, labels) for i, k, labels in rest if not met(labels, rule[:size])]


def noisy(spark, n=900):
    """Text attributes; each check is decided by two of them, with some noise."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        a, b, c = rng.choice("pqrs"), rng.choice("uvw"), f"v{rng.randrange(8)}"
        ko = "one" if (a == "p" and b != "u") or c == "v3" else "two" if b == "w" and c in ("v1", "v2") else None
        if rng.random() < 0.04:
            ko = rng.choice(["one", "two", None])
        rows.append((str(i), ko is not None, ko, a, b, c))
    return rows, spark.createDataFrame(rows, "case_id string, knocked_out_case boolean, knockout_activity string, a string, b string, c string")


@pytest.mark.parametrize("local", [0, learn.LOCAL_COMBINATIONS])
def test_unlimited_irep_is_the_brute_force_one(spark, monkeypatch, local):
    monkeypatch.setattr(learn, "LOCAL_COMBINATIONS", local)
    rows, cases = noisy(spark)
    settings = learn.LearnSettings(prune_size=0.33)
    found = learn.learn_rules(cases, ["one", "two", "none"], ["a", "b", "c"], "IREP", settings)
    plain = [(i, ko, dict(zip("abc", labels))) for i, _, ko, *labels in rows]
    for ko in ("one", "two", "none"):
        wanted = brute_irep(plain, ko, ["a", "b", "c"], 0.33)
        assert [tuple((c.feature, c.value) for c in rule) for rule in found[ko]] == wanted
    assert len(found["one"]) > 1


def test_jobs_and_a_table_at_hand_give_the_same_rules(spark, monkeypatch):
    cases = planted(spark, 900)
    settings = learn.LearnSettings(max_rules=3, k=1)
    found = []
    for local in (0, learn.LOCAL_COMBINATIONS):
        monkeypatch.setattr(learn, "LOCAL_COMBINATIONS", local)
        found.append(learn.learn_rules(cases, ["amount", "kind"], ["amount", "kind", "risk"], "RIPPER", settings))
    assert found[0] == found[1] and found[0]["amount"]


@pytest.mark.parametrize("algorithm", ["IREP", "RIPPER"])
def test_unlimited_learning_finds_planted_rules(spark, algorithm):
    cases = planted(spark, 2_000)
    found = learn.learn_rules(cases, ["amount", "kind"], ["amount", "kind", "risk"], algorithm)
    quality = {r["ko_activity"]: r["f1_score"] for r in rules.holdout_quality(cases, found).collect()}
    assert min(quality.values()) >= 0.95


def test_grid_search_learns_every_fold_and_setting(spark):
    from casegate.operators.tuning import RANDOM_FOLDS, best_settings, grid_scores

    _, cases = noisy(spark, 400)
    cases = cases.withColumn("start_ts", F.lit("2022-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("case_id").cast("int")))
    grid = {"prune_size": [0.33, 0.5], "n_discretize_bins": [10]}
    scores = {(r["ko_activity"], r["prune_size"]): r["mean_score"] for r in grid_scores(cases, ["one", "two"], ["a", "b", "c"], "IREP", grid, time_aware=False).collect()}
    assert set(scores) == {(ko, p) for ko in ("one", "two") for p in (0.33, 0.5)}
    folds = splits.stratified_folds(cases, RANDOM_FOLDS, F.col("knockout_activity"))
    own = []
    for fold in range(1, RANDOM_FOLDS + 1):
        found = learn.learn_rules(folds.filter(F.col("fold") != fold), ["one"], ["a", "b", "c"], "IREP", learn.LearnSettings(prune_size=0.33))
        hit = [(rules.predicate(found["one"]))]
        r = folds.filter(F.col("fold") == fold).select(hit[0].alias("y"), F.col("knockout_activity").eqNullSafe("one").alias("t")).collect()
        tpr = sum(x.y and x.t for x in r) / sum(x.t for x in r)
        tnr = sum(not x.y and not x.t for x in r) / sum(not x.t for x in r)
        own.append((tpr + tnr) / 2)
    assert scores["one", 0.33] == pytest.approx(sum(own) / len(own))
    best = best_settings(grid_scores(cases, ["one"], ["a", "b", "c"], "IREP", grid))
    assert best["one"].prune_size in (0.33, 0.5)


def test_many_categories_and_checks(spark):
    rows = [(str(i), True, f"ko{i % 1500}", f"cat{i % 300}") for i in range(3_000)]
    cases = spark.createDataFrame(rows, "case_id string, knocked_out_case boolean, knockout_activity string, kind string")
    assert len(names_of(cases, "knockout_activity")) == 1500
    found, teachers = learn.surrogate_rules(cases, ["ko7"], ["kind"], learn.LearnSettings(prune_size=0.0), test=cases)
    assert teachers["ko7"].auc is not None and set(found) == {"ko7"}
