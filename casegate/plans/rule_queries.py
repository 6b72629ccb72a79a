"""Queries on case tables, splits, rules and their measures."""

from __future__ import annotations

from dataclasses import asdict
from functools import partial

from pyspark.sql import functions as F

from casegate.functions import stats
from casegate.functions.bins import quantile_edges
from casegate.functions.text import percent
from casegate.lineage import write_table
from casegate.operators import casetable, learn, metrics, refit, roc, rules, splits, targets
from casegate.operators.rules import Condition
from casegate.plans.log_queries import day_variant_rows, rounded
from casegate.plans.oracles import PARTS, with_parts
from casegate.plans.registry import day_labelled, orders, orders_labelled, register
from casegate.schema import ACTIVITY, BY_END, CASE, KO, KO_KEY, REJECTED

FEATURES = ["c_acctbal", "o_totalprice", "o_orderpriority"]

FIXED_RULES = {
    "Check Balance": [
        (Condition("c_acctbal", "<", hi=-200.0),),
        (Condition("c_acctbal", "between", lo=-200.0, hi=50.0),),
    ],
    "Check Price": [(Condition("o_totalprice", ">=", lo=380000.0),)],
    "Check Priority": [
        (
            Condition("o_orderpriority", "=", value="5-LOW"),
            Condition("o_totalprice", "between", lo=100000.0, hi=400000.0),
        )
    ],
}

PARTS["ocases"] = """
SELECT l.case_id, l.knocked_out_case, l.knockout_activity, e.last_ts AS start_ts, o.o_totalprice, o.o_orderpriority, c.c_acctbal
FROM order_labels l JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = l.case_id
JOIN customer c ON c.c_custkey = o.o_custkey JOIN order_edges e ON e.case_id = l.case_id"""

PARTS["okos"] = "SELECT unnest(['Check Balance', 'Check Price', 'Check Priority']) AS ko_activity"

PARTS["opred"] = """
SELECT k.ko_activity, c.*, coalesce(c.knockout_activity = k.ko_activity, false) AS is_ko,
       CASE k.ko_activity WHEN 'Check Balance' THEN c_acctbal < 50 WHEN 'Check Price' THEN o_totalprice >= 380000
            ELSE o_orderpriority = '5-LOW' AND o_totalprice >= 100000 AND o_totalprice < 400000 END AS predicted
FROM ocases c, okos k"""

PARTS["oavail"] = """
SELECT activity AS ko_activity, count(DISTINCT case_id) AS n FROM ord WHERE activity LIKE 'Check %' GROUP BY 1"""

PARTS["otimed"] = """
SELECT *, row_number() OVER (ORDER BY start_ts, case_id) - 1 AS time_rank, count(*) OVER () AS n FROM ocases"""

PARTS["oclassed"] = """
SELECT *, row_number() OVER (PARTITION BY knockout_activity ORDER BY md5(case_id || '|0'), case_id) - 1 AS r,
       count(*) OVER (PARTITION BY knockout_activity) AS class_size FROM ocases"""

PARTS["ofolds"] = """
SELECT *, CASE WHEN time_rank < n - 5 * (n // 6) THEN 0
               ELSE (time_rank - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM otimed"""

PARTS["ofoldrates"] = """
SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr FROM (
  SELECT k.ko_activity, f.fold, count(*) FILTER (p.predicted AND p.is_ko) AS tp,
         count(*) FILTER (p.predicted AND NOT p.is_ko) AS fp, count(*) FILTER (NOT p.predicted AND p.is_ko) AS fn,
         count(*) FILTER (NOT p.predicted AND NOT p.is_ko) AS tn
  FROM ofolds f JOIN opred p ON p.case_id = f.case_id JOIN okos k ON k.ko_activity = p.ko_activity
  WHERE f.fold > 0 GROUP BY 1, 2)"""

PARTS["ocurve"] = """
SELECT ko_activity, point, CASE WHEN point = 99 THEN 1.0 ELSE avg(y) END AS mean_tpr, stddev_pop(y) AS std_tpr FROM (
  SELECT ko_activity, point, CASE WHEN point = 0 THEN 0.0
     WHEN x <= fpr THEN CASE WHEN fpr > 0 THEN tpr * x / fpr ELSE tpr END
     ELSE tpr + (1 - tpr) * (x - fpr) / nullif(1 - fpr, 0) END AS y
  FROM (SELECT *, point / 99.0::DOUBLE AS x FROM ofoldrates, (SELECT unnest(range(100)) AS point)))
GROUP BY 1, 2"""

PARTS["oscored"] = """
SELECT case_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS score, coalesce(knockout_activity = 'Check Price', false) AS label
FROM ocases"""


def order_cases(spark, folder):
    data = orders_labelled(spark, folder)
    return casetable.case_table(data.base, data.labels)


def order_cases_and_available(spark, folder):
    """Cases and available cases per check, of one written log."""
    data = orders_labelled(spark, folder)
    return casetable.case_table(data.base, data.labels), metrics.available_cases(data.base, sorted(FIXED_RULES))


# --- case tables --------------------------------------------------------------------

@register("b7_numeric_coercion", """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_totalprice AS price, o_orderpriority AS priority FROM orders""")
def b7(spark, folder):
    table = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias(CASE),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    return casetable.coerce_numeric(table, ["price", "priority"])


@register("b8_drop_empty_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def b8(spark, folder):
    table = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_totalprice", F.lit(None).cast("string").alias("nothing")
    )
    return casetable.drop_empty_columns(table, ["o_totalprice", "nothing"])


@register("b9_complete_cases", with_parts(
    "SELECT case_id, c_acctbal FROM ocases WHERE o_orderpriority <> '1-URGENT'"))
def b9(spark, folder):
    data = orders_labelled(spark, folder)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    log = data.base.withColumn("c_acctbal", F.when(~urgent, F.col("c_acctbal")))
    return casetable.case_table(log, data.labels).select(CASE, "c_acctbal")


@register("b10_one_vs_rest", with_parts("SELECT case_id, ko_activity, is_ko FROM opred"))
def b10(spark, folder):
    data = orders_labelled(spark, folder)
    return rules.one_vs_rest(data.labels, data.kos).select(CASE, KO_KEY, "is_ko")


@register("e7_last_non_null", with_parts("SELECT case_id, start_ts, c_acctbal, o_totalprice, o_orderpriority FROM ocases"))
def e7(spark, folder):
    return casetable.last_values(orders(spark, folder), FEATURES).select(CASE, "start_ts", *FEATURES)


@register("j1_case_table", with_parts(
    "SELECT case_id, start_ts, c_acctbal, o_totalprice, o_orderpriority, knocked_out_case, knockout_activity FROM ocases"))
def j1(spark, folder):
    return order_cases(spark, folder).select(CASE, "start_ts", *FEATURES, REJECTED, KO)


# --- splits ---------------------------------------------------------------------------

@register("e8_temporal_rank", with_parts("SELECT case_id, time_rank FROM otimed"))
def e8(spark, folder):
    return splits.temporal_rank(order_cases(spark, folder)).select(CASE, "time_rank")


@register("j2_temporal_holdout", with_parts(
    "SELECT case_id, time_rank >= n - CAST(ceil(n * 0.2) AS BIGINT) AS is_test FROM otimed"))
def j2(spark, folder):
    return splits.temporal_holdout(order_cases(spark, folder)).select(CASE, "is_test")


@register("j3_stratified_holdout", with_parts(
    "SELECT case_id, knockout_activity, r < CAST(ceil(class_size * 0.2) AS BIGINT) AS is_test FROM oclassed"))
def j3(spark, folder):
    return splits.stratified_holdout(order_cases(spark, folder), F.col(KO)).select(CASE, KO, "is_test")


@register("j4_balanced_classes", with_parts("""
SELECT case_id, knocked_out_case FROM (
  SELECT case_id, knocked_out_case,
         row_number() OVER (PARTITION BY knocked_out_case ORDER BY md5(case_id || '|1'), case_id) AS r,
         least(count(*) FILTER (knocked_out_case) OVER (), count(*) FILTER (NOT knocked_out_case) OVER ()) AS smallest
  FROM ocases) WHERE r <= smallest"""))
def j4(spark, folder):
    return splits.balance_classes(order_cases(spark, folder), F.col(REJECTED)).select(CASE, REJECTED)


@register("j9_time_folds", with_parts("SELECT case_id, CAST(fold AS INTEGER) AS fold FROM ofolds"))
def j9(spark, folder):
    return splits.time_folds(order_cases(spark, folder), 5).select(CASE, "fold")


@register("j9_stratified_folds", with_parts("SELECT case_id, CAST(r % 5 + 1 AS INTEGER) AS fold FROM oclassed"))
def j9_stratified(spark, folder):
    return splits.stratified_folds(order_cases(spark, folder), 5, F.col(KO)).select(CASE, "fold")


# --- rule measures ----------------------------------------------------------------------

@register("b12_apply_rules", with_parts("SELECT case_id, ko_activity, predicted FROM opred"))
def b12(spark, folder):
    return rules.predictions(order_cases(spark, folder), FIXED_RULES).select(CASE, KO_KEY, "predicted")


MEASURES = """
SELECT p.ko_activity, round(count(*) FILTER (predicted) / a.n, 6) AS support,
       round(count(*) FILTER (predicted AND is_ko) / count(*) FILTER (predicted), 6) AS confidence
FROM opred p JOIN oavail a ON a.ko_activity = p.ko_activity GROUP BY p.ko_activity, a.n"""


def measured(spark, folder):
    cases, available = order_cases_and_available(spark, folder)
    found = rules.support_and_confidence(cases, FIXED_RULES, available)
    return rounded(found, "support", "confidence")


@register("b13_low_confidence", with_parts(f"SELECT * FROM ({MEASURES}) WHERE confidence < 0.9"))
def b13(spark, folder):
    return rules.low_confidence(measured(spark, folder), 0.9)


@register("d13_rule_support", with_parts(f"SELECT ko_activity, support FROM ({MEASURES})"))
def d13(spark, folder):
    return measured(spark, folder).select(KO_KEY, "support")


@register("d14_rule_confidence", with_parts(f"SELECT ko_activity, confidence FROM ({MEASURES})"))
def d14(spark, folder):
    return measured(spark, folder).select(KO_KEY, "confidence")


QUALITY = """
SELECT ko_activity, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
       round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS roc_auc
FROM (SELECT p.ko_activity, count(*) FILTER (predicted AND is_ko) AS tp, count(*) FILTER (predicted AND NOT is_ko) AS fp,
             count(*) FILTER (NOT predicted AND is_ko) AS fn, count(*) FILTER (NOT predicted AND NOT is_ko) AS tn
      FROM opred p JOIN otimed t ON t.case_id = p.case_id WHERE time_rank >= n - CAST(ceil(n * 0.2) AS BIGINT) GROUP BY 1)"""


@register("d15_holdout_quality", with_parts(QUALITY))
def d15(spark, folder):
    held_out = splits.temporal_holdout(order_cases(spark, folder)).filter("is_test")
    return rounded(rules.holdout_quality(held_out, FIXED_RULES), "precision", "recall", "f1_score", "roc_auc")


def order_rates(spark, folder):
    folds = splits.time_folds(order_cases(spark, folder), 5)
    return roc.fold_rates(roc.fold_counts(folds.filter(F.col("fold") > 0), FIXED_RULES))


@register("d16_roc_curve_by_folds", with_parts("""
SELECT ko_activity, CAST(point AS INTEGER) AS point, round(mean_tpr, 6) AS mean_tpr, round(std_tpr, 6) AS std_tpr FROM ocurve"""))
def d16(spark, folder):
    curve = roc.mean_curve(order_rates(spark, folder))
    return rounded(curve.select(KO_KEY, "point", "mean_tpr", "std_tpr"), "mean_tpr", "std_tpr")


@register("d16_roc_area_by_folds", with_parts("""
SELECT c.ko_activity, round(c.mean_auc, 6) AS mean_auc, round(r.std_auc, 6) AS std_auc FROM (
  SELECT a.ko_activity, sum((a.mean_tpr + b.mean_tpr) / 2 / 99) AS mean_auc
  FROM ocurve a JOIN ocurve b ON b.ko_activity = a.ko_activity AND b.point = a.point + 1 GROUP BY 1) c
JOIN (SELECT ko_activity, stddev_pop(coalesce((1 + tpr - fpr) / 2, 0)) AS std_auc FROM ofoldrates GROUP BY 1) r
  ON r.ko_activity = c.ko_activity"""))
def d16_area(spark, folder):
    return rounded(roc.mean_area(order_rates(spark, folder)), "mean_auc", "std_auc")


def scored(spark, folder):
    cases = order_cases(spark, folder)
    return cases.select(
        CASE,
        F.floor(F.col("o_totalprice") / 1000).alias("score"),
        F.col(KO).eqNullSafe("Check Price").alias("label"),
    )


@register("d17_score_area", with_parts("""
SELECT round(sum(CASE WHEN p.score > n.score THEN p.c * n.c WHEN p.score = n.score THEN p.c * n.c / 2 ELSE 0 END)
       / (SELECT count(*) FILTER (label) * count(*) FILTER (NOT label) FROM oscored), 6) AS auc
FROM (SELECT score, count(*) AS c FROM oscored WHERE label GROUP BY 1) p,
     (SELECT score, count(*) AS c FROM oscored WHERE NOT label GROUP BY 1) n"""))
def d17(spark, folder):
    return rounded(roc.score_area(scored(spark, folder)), "auc")


@register("d17_score_curve", with_parts("""
SELECT score, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr
FROM (SELECT score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM oscored GROUP BY 1)
WINDOW w AS (ORDER BY score DESC)"""))
def d17_curve(spark, folder):
    return rounded(roc.score_curve(scored(spark, folder)), "tpr", "fpr")


@register("j11_metrics_table", with_parts(f"""
SELECT m.ko_activity, m.support, m.confidence, q.precision, q.recall, q.f1_score, q.roc_auc,
       CASE m.ko_activity WHEN 'Check Balance' THEN 2 ELSE 1 END AS rule_count,
       CASE m.ko_activity WHEN 'Check Price' THEN 1 ELSE 2 END AS condition_count
FROM ({MEASURES}) m JOIN ({QUALITY}) q ON q.ko_activity = m.ko_activity"""))
def j11(spark, folder):
    cases, available = order_cases_and_available(spark, folder)
    split = splits.temporal_holdout(cases)
    table = rules.rule_metrics(split, split.filter("is_test"), FIXED_RULES, available)
    table = rounded(table, "support", "confidence", "precision", "recall", "f1_score", "roc_auc")
    return table.drop("predicted", "predicted_true")


# --- statistics ---------------------------------------------------------------------------

@register("d22_rule_histogram", with_parts("""
SELECT CAST(bin AS INTEGER) AS bin, cases, round(lo + bin * w, 6) AS bin_low, round(lo + (bin + 1) * w, 6) AS bin_high,
       lo + (bin + 1) * w > 380000 AS in_rule
FROM (SELECT least(floor((o_totalprice - lo) / w), 19) AS bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS cases
      FROM ocases, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM ocases)
      GROUP BY 1)"""))
def d22(spark, folder):
    table = rules.rules_table(spark, {"Check Price": FIXED_RULES["Check Price"]})
    found = stats.histogram(
        order_cases(spark, folder), "o_totalprice", 20, rules.condition_intervals(table).select("lo", "hi")
    )
    return rounded(found, "bin_low", "bin_high")


RANGES = """
SELECT knockout_activity AS ko_activity, feature, min(x) AS low, max(x) AS high FROM (
  SELECT knockout_activity, 'c_acctbal' AS feature, c_acctbal AS x FROM ocases WHERE knockout_activity = 'Check Balance'
  UNION ALL SELECT knockout_activity, 'o_totalprice', o_totalprice FROM ocases
  WHERE knockout_activity IN ('Check Price', 'Check Priority')) GROUP BY 1, 2"""


def ranges(spark, folder):
    table = rules.rules_table(spark, FIXED_RULES)
    return stats.value_ranges(order_cases(spark, folder), table, FEATURES)


@register("d23_value_ranges", with_parts(RANGES))
def d23(spark, folder):
    return ranges(spark, folder)


@register("k8_rule_change_options", with_parts(f"""
SELECT r.*, CASE r.ko_activity WHEN 'Check Balance' THEN '[[c_acctbal=<-200] V [c_acctbal=-200-50]]'
   WHEN 'Check Price' THEN '[[o_totalprice=>380000]]'
   ELSE '[[o_orderpriority=5-LOW ^ o_totalprice=100000-400000]]' END AS rejection_rule FROM ({RANGES}) r"""))
def k8(spark, folder):
    from casegate.operators.redesign import rule_change

    table = rules.rules_table(spark, FIXED_RULES)
    return rule_change(rules.rules_text(table), ranges(spark, folder))


@register("d24_mean_interval", with_parts("""
SELECT round(avg(o_totalprice), 2) AS mean, count(*) AS n,
       round((avg(o_totalprice) - 1.960201 * stddev_samp(o_totalprice) / sqrt(count(*))) / 1000, 1) AS low_k,
       round((avg(o_totalprice) + 1.960201 * stddev_samp(o_totalprice) / sqrt(count(*))) / 1000, 1) AS high_k
FROM orders"""))
def d24(spark, folder):
    table = stats.t_interval(spark.read.parquet(f"{folder}/orders.parquet"), "o_totalprice")
    return table.select(
        F.round("mean", 2).alias("mean"),
        "n",
        F.round(F.col("low") / 1000, 1).alias("low_k"),
        F.round(F.col("high") / 1000, 1).alias("high_k"),
    )


def bootstrap_sql() -> str:
    copies = " + ".join(f"CAST(h >= {t} AS INTEGER)" for t in stats.poisson_thresholds())
    return f"""
SELECT round(v[3], 4) AS low, round(v[98], 4) AS high FROM (
  SELECT list(s ORDER BY s) AS v FROM (
    SELECT r, sum(o_totalprice * w) / sum(w) AS s FROM (
      SELECT r, o_totalprice, {copies} AS w FROM (
        SELECT o_totalprice, r, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT) AS h
        FROM orders, (SELECT unnest(range(100)) AS r))) GROUP BY r))"""


@register("d25_bootstrap_interval", bootstrap_sql())
def d25(spark, folder):
    table = spark.read.parquet(f"{folder}/orders.parquet")
    return rounded(stats.bootstrap_interval(table, "o_totalprice", key="o_orderkey"), "low", "high", digits=4)


PARTS["oedges"] = """
SELECT feature, CAST(i AS BIGINT) AS edge, x FROM (
  SELECT 'c_acctbal' AS feature, c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS rn, count(*) OVER () AS n FROM ocases
  UNION ALL
  SELECT 'o_totalprice', o_totalprice, row_number() OVER (ORDER BY o_totalprice), count(*) OVER () FROM ocases),
  (SELECT unnest(range(1, 10)) AS i) WHERE rn = (i * n + 9) // 10"""


@register("h8_equal_frequency_bins", with_parts("SELECT feature, edge, x FROM oedges"))
def h8(spark, folder):
    edges = quantile_edges(order_cases(spark, folder), ["c_acctbal", "o_totalprice"], 10)
    return edges.select("feature", "edge", "x")


@register("h9_max_abs_scaling", with_parts("""
SELECT case_id, time_rank >= n - CAST(ceil(n * 0.2) AS BIGINT) AS is_test,
       round(coalesce(c_acctbal / (SELECT max(abs(c_acctbal)) FROM otimed WHERE time_rank < n - CAST(ceil(n * 0.2) AS BIGINT)), 0), 6) AS c_acctbal,
       round(coalesce(o_totalprice / (SELECT max(abs(o_totalprice)) FROM otimed WHERE time_rank < n - CAST(ceil(n * 0.2) AS BIGINT)), 0), 6) AS o_totalprice,
       round((extract('hour' FROM start_ts) * 3600 + extract('minute' FROM start_ts) * 60
              + floor(extract('second' FROM start_ts))) / 86400, 6) AS st_daytime
FROM otimed"""))
def h9(spark, folder):
    daytime = F.hour("start_ts") * 3600 + F.minute("start_ts") * 60 + F.second("start_ts")
    split = splits.temporal_holdout(order_cases(spark, folder)).withColumn("st_daytime", daytime)
    scaled = ["c_acctbal", "o_totalprice"]
    parts = stats.max_abs_scale(split.filter(~F.col("is_test")), split.filter("is_test"), scaled, ["st_daytime"])
    both = parts[0].unionByName(parts[1]).select(CASE, "is_test", *scaled, "st_daytime")
    return rounded(both, *scaled, "st_daytime")


# --- rules as tables and text ---------------------------------------------------------------

def decile_rules(spark, folder):
    """One rule per decile of the order price: rules that come from the data."""
    edges = quantile_edges(order_cases(spark, folder), ["o_totalprice"], 10)
    return edges.select(
        F.lit("Check Price").alias(KO_KEY),
        F.col("edge").cast("int").alias("rule_id"),
        F.lit(0).alias("cond_id"),
        "feature",
        F.when(F.col("edge") % 3 == 0, "between").otherwise(">=").alias("op"),
        F.col("x").alias("lo"),
        F.when(F.col("edge") % 3 == 0, F.col("x") + 1000).alias("hi"),
        F.lit(None).cast("string").alias("value"),
    )


PARTS["deciles"] = """
SELECT edge AS i, x, CASE WHEN edge % 3 = 0 THEN x + 1000 END AS hi FROM oedges WHERE feature = 'o_totalprice'"""


@register("h6_rules_text", with_parts("""
SELECT 'Check Price' AS ko_activity, '[' || string_agg('[o_totalprice=' || CASE WHEN hi IS NULL THEN '>' || t(x)
   ELSE t(x) || '-' || t(hi) END || ']', ' V ' ORDER BY i) || ']' AS rejection_rule FROM deciles""").replace(
    "t(x)", "regexp_replace(printf('%.2f', x), '\\.?0+$', '')").replace(
    "t(hi)", "regexp_replace(printf('%.2f', hi), '\\.?0+$', '')"))
def h6(spark, folder):
    return rules.rules_text(decile_rules(spark, folder))


@register("h7_condition_intervals", with_parts("""
SELECT 'Check Price' AS ko_activity, CAST(i AS INTEGER) AS rule_id, 'o_totalprice' AS feature, x AS lo, hi FROM deciles"""))
def h7(spark, folder):
    found = rules.condition_intervals(decile_rules(spark, folder))
    return found.select(KO_KEY, "rule_id", "feature", "lo", "hi")


@register("d18_rule_counts", with_parts(
    "SELECT 'Check Price' AS ko_activity, count(DISTINCT i) AS rule_count, count(*) AS condition_count FROM deciles"))
def d18(spark, folder):
    return rules.rule_counts(decile_rules(spark, folder))


@register("k1_rule_attributes", with_parts(
    "SELECT DISTINCT 'Check Price' AS ko_activity, 'o_totalprice' AS feature FROM deciles"))
def k1(spark, folder):
    return rules.rule_features(decile_rules(spark, folder))


@register("k10_simplified_rules", with_parts("""
SELECT 'Check Price' AS ko_activity, '>=' AS op, min(x) AS lo, CAST(NULL AS DOUBLE) AS hi FROM deciles"""))
def k10(spark, folder):
    return rules.simplify_rules(decile_rules(spark, folder)).select(KO_KEY, "op", "lo", "hi")


# --- learning ---------------------------------------------------------------------------------

PARTS["obinned"] = """
SELECT case_id, knockout_activity, 'o_orderpriority' AS feature, o_orderpriority AS label FROM ocases
UNION ALL
SELECT c.case_id, any_value(c.knockout_activity), e.feature,
       CAST(count(*) FILTER (CASE e.feature WHEN 'c_acctbal' THEN c.c_acctbal ELSE c.o_totalprice END >= e.x) AS VARCHAR)
FROM ocases c, (SELECT DISTINCT feature, x FROM oedges) e GROUP BY c.case_id, e.feature"""

PARTS["ogains"] = """
SELECT k.ko_activity, f.feature, f.label, count(*) FILTER (f.knockout_activity IS NOT DISTINCT FROM k.ko_activity) AS p,
       count(*) FILTER (f.knockout_activity IS DISTINCT FROM k.ko_activity) AS n FROM obinned f, okos k GROUP BY 1, 2, 3"""


@register("j5_first_growth_step", with_parts("""
SELECT ko_activity, feature, label, p, n, round(gain, 6) AS gain FROM (
  SELECT *, row_number() OVER (PARTITION BY ko_activity ORDER BY round(gain, 9) DESC, feature, label) AS r FROM (
    SELECT g.*, p * (log2(p / (p + n)) - log2(t.p0 / t.c0)) AS gain FROM ogains g
    JOIN (SELECT k.ko_activity, count(*) FILTER (c.knockout_activity = k.ko_activity) AS p0, count(*) AS c0
          FROM ocases c, okos k GROUP BY 1) t ON t.ko_activity = g.ko_activity WHERE p > 0)) WHERE r = 1"""))
def j5_step(spark, folder):
    cases = order_cases(spark, folder)
    kos = sorted(FIXED_RULES)
    settings = learn.LearnSettings(prune_size=0.0)
    counts = learn.count_tables({0: (cases, settings.n_discretize_bins)}, FEATURES, [0.0])
    looks = [learn.Learner(counts, 0, ko, settings).look([], growing=True) for ko in kos]
    best = [seen.best for seen in learn.Asker(counts).answer(looks)]
    rows = [(ko, f, label, t.grow_p, t.grow_n, round(gain, 6)) for ko, (f, label, gain, t) in zip(kos, best, strict=True)]
    return spark.createDataFrame(rows, f"{KO_KEY} string, feature string, label string, p long, n long, gain double")


def learned(spark, folder, algorithm):
    """Rules of all checks with the configuration's own settings: no limit on rules or conditions."""
    split = write_table(splits.temporal_holdout(order_cases(spark, folder)))
    return split, learn.learn_rules(split.filter(~F.col("is_test")), sorted(FIXED_RULES), FEATURES, algorithm)


@register("j5_irep_rules")
def j5(spark, folder):
    return rules.rules_table(spark, learned(spark, folder, "IREP")[1])


@register("j6_ripper_rules")
def j6(spark, folder):
    return rules.rules_table(spark, learned(spark, folder, "RIPPER")[1])


@register("j10_learned_rule_quality")
def j10(spark, folder):
    split, found = learned(spark, folder, "IREP")
    return rules.holdout_quality(split.filter("is_test"), found)


def holdout(spark, folder):
    split = write_table(splits.temporal_holdout(order_cases(spark, folder)))
    return split.filter(~F.col("is_test")), split.filter("is_test")


@register("j7_surrogate_rules")
def j7(spark, folder):
    train, _ = holdout(spark, folder)
    return rules.rules_table(spark, learn.surrogate_rules(train, sorted(FIXED_RULES), FEATURES)[0])


@register("j7_teacher_areas")
def j7_areas(spark, folder):
    train, test = holdout(spark, folder)
    teachers = {ko: learn.fit_teacher(train, ko, FEATURES, test=test) for ko in sorted(FIXED_RULES)}
    rows = [(ko, one.auc, max(one.importances, key=one.importances.get)) for ko, one in teachers.items()]
    return spark.createDataFrame(rows, f"{KO_KEY} string, auc double, first_attribute string")


def customer_cases(spark, folder):
    """Cases with the customer as an attribute of very many values."""
    orders_of = spark.read.parquet(f"{folder}/orders.parquet")
    customers = orders_of.select(F.col("o_orderkey").cast("string").alias(CASE), F.col("o_custkey").cast("string").alias("customer"))
    return order_cases(spark, folder).join(customers, CASE)


@register("j7_target_statistics", with_parts("""
SELECT case_id, round((coalesce(sum(y) OVER before, 0) + prior) / (coalesce(count(*) OVER before, 0) + 1), 6) AS ordered_share,
       round((sum(y) OVER (PARTITION BY customer) + prior) / (count(*) OVER (PARTITION BY customer) + 1), 6) AS share
FROM (SELECT c.case_id, o.o_custkey AS customer, CAST('0x' || md5(c.case_id || '|0')[1:6] AS BIGINT) % 64 AS block,
             CAST(coalesce(c.knockout_activity = 'Check Balance', false) AS INTEGER) AS y, avg(CAST(coalesce(
               c.knockout_activity = 'Check Balance', false) AS INTEGER)) OVER () AS prior
      FROM ocases c JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = c.case_id)
WINDOW before AS (PARTITION BY customer ORDER BY block RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)"""))
def j7_statistics(spark, folder):
    """The customer as the teacher sees it: while it trains, and afterwards."""
    cases = write_table(customer_cases(spark, folder)).withColumn("_y", F.col(KO).eqNullSafe("Check Balance").cast("double"))
    codes = targets.target_codes(cases, ["customer"])
    found = codes.coded(codes.coded(cases, ["ordered_share"], ordered=True), ["share"], ordered=False)
    return rounded(found.select(CASE, "ordered_share", "share"), "ordered_share", "share")


@register("j7_teacher_of_customers")
def j7_customers(spark, folder):
    """Areas of teachers that also read the customer, over deeper trees."""
    split = write_table(splits.temporal_holdout(customer_cases(spark, folder)))
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    teacher = partial(learn.boosted_trees, depth=8)
    fitted = {ko: learn.fit_teacher(train, ko, ["customer", "o_orderpriority"], teacher, test) for ko in sorted(FIXED_RULES)}
    rows = [(ko, one.auc, max(one.importances, key=one.importances.get)) for ko, one in fitted.items()]
    return spark.createDataFrame(rows, f"{KO_KEY} string, auc double, first_attribute string")


@register("j8_grid_search")
def j8(spark, folder):
    """The default grid of IREP: every check, fold and setting."""
    from casegate.operators.tuning import grid_scores

    return grid_scores(order_cases(spark, folder), sorted(FIXED_RULES), FEATURES, "IREP")


# --- refits per fold -----------------------------------------------------------------------------

#: One rule of one condition: SQL can learn it as well, for every fold anew.
ONE_CONDITION = learn.LearnSettings(max_rules=1, max_rule_conds=1, prune_size=0.0)

PARTS["rtrain"] = """
SELECT t.fold, f.case_id, f.knockout_activity, f.c_acctbal, f.o_totalprice, f.o_orderpriority
FROM (SELECT unnest(range(1, 6)) AS fold) t JOIN ofolds f ON f.fold < t.fold"""

PARTS["redges"] = """
SELECT DISTINCT fold, feature, x FROM (
  SELECT fold, 'c_acctbal' AS feature, c_acctbal AS x, row_number() OVER (PARTITION BY fold ORDER BY c_acctbal) AS rn,
         count(*) OVER (PARTITION BY fold) AS n FROM rtrain
  UNION ALL
  SELECT fold, 'o_totalprice', o_totalprice, row_number() OVER (PARTITION BY fold ORDER BY o_totalprice),
         count(*) OVER (PARTITION BY fold) FROM rtrain), (SELECT unnest(range(1, 10)) AS i) WHERE rn = (i * n + 9) // 10"""

PARTS["rlists"] = "SELECT fold, feature, list(x) AS edges FROM redges GROUP BY 1, 2"

PARTS["rbinned"] = """
SELECT fold, knockout_activity, 'o_orderpriority' AS feature, o_orderpriority AS label FROM rtrain
UNION ALL
SELECT r.fold, r.knockout_activity, e.feature,
       CAST(len(list_filter(e.edges, lambda x: CASE e.feature WHEN 'c_acctbal' THEN r.c_acctbal ELSE r.o_totalprice END >= x)) AS VARCHAR)
FROM rtrain r JOIN rlists e ON e.fold = r.fold"""

PARTS["rbest"] = """
SELECT fold, ko_activity, feature, label FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, ko_activity ORDER BY round(gain, 9) DESC, feature, label) AS r FROM (
    SELECT g.*, p * (log2(p / c) - log2(t.p0 / t.c0)) AS gain FROM
      (SELECT fold, ko_activity, feature, label, count(*) AS c,
              count(*) FILTER (knockout_activity IS NOT DISTINCT FROM ko_activity) AS p FROM rbinned, okos GROUP BY 1, 2, 3, 4) g
    JOIN (SELECT fold, ko_activity, count(*) FILTER (knockout_activity = ko_activity) AS p0, count(*) AS c0
          FROM rtrain, okos GROUP BY 1, 2) t ON t.fold = g.fold AND t.ko_activity = g.ko_activity
    WHERE p > 0)) WHERE r = 1 AND gain > 1e-9"""

PARTS["rrates"] = """
SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr FROM (
  SELECT ko_activity, fold, count(*) FILTER (hit AND is_ko) AS tp, count(*) FILTER (hit AND NOT is_ko) AS fp,
         count(*) FILTER (NOT hit AND is_ko) AS fn, count(*) FILTER (NOT hit AND NOT is_ko) AS tn
  FROM (SELECT k.ko_activity, f.fold, coalesce(f.knockout_activity = k.ko_activity, false) AS is_ko,
               coalesce(b.label = CASE b.feature WHEN 'o_orderpriority' THEN f.o_orderpriority ELSE CAST(len(list_filter(e.edges,
                 lambda x: CASE b.feature WHEN 'c_acctbal' THEN f.c_acctbal ELSE f.o_totalprice END >= x)) AS VARCHAR) END, false) AS hit
        FROM ofolds f CROSS JOIN okos k LEFT JOIN rbest b ON b.fold = f.fold AND b.ko_activity = k.ko_activity
        LEFT JOIN rlists e ON e.fold = b.fold AND e.feature = b.feature WHERE f.fold > 0) GROUP BY 1, 2)"""

PARTS["rareas"] = PARTS["ocurve"].replace("ofoldrates", "rrates")


def refitted(spark, folder, settings=ONE_CONDITION):
    cases = order_cases(spark, folder)
    return refit.refits(cases, [(ko, settings) for ko in sorted(FIXED_RULES)], FEATURES, "IREP")


@register("d16_refit_rates_by_folds", with_parts("""
SELECT ko_activity, CAST(fold AS INTEGER) AS fold, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(coalesce((1 + tpr - fpr) / 2, 0), 6) AS auc FROM rrates"""))
def d16_refit(spark, folder):
    """Rules of one condition, learnt for every fold from the cases before it."""
    counts = refit.refit_counts(spark, refitted(spark, folder))
    return rounded(roc.fold_rates(counts), "tpr", "fpr", "auc")


@register("d16_refit_rules_by_folds", with_parts("""
SELECT b.ko_activity, CAST(b.fold AS INTEGER) AS fold, b.feature,
       CASE WHEN b.feature = 'o_orderpriority' THEN b.label END AS value,
       CASE WHEN b.feature <> 'o_orderpriority' THEN list_sort(e.edges)[TRY_CAST(b.label AS BIGINT)] END AS lo,
       CASE WHEN b.feature <> 'o_orderpriority' THEN list_sort(e.edges)[TRY_CAST(b.label AS BIGINT) + 1] END AS hi
FROM rbest b LEFT JOIN rlists e ON e.fold = b.fold AND e.feature = b.feature"""))
def d16_refit_rules(spark, folder):
    rows = [
        (one.ko, one.fold, c.feature, c.value, c.lo, c.hi)
        for one in refitted(spark, folder) for rule in one.rules for c in rule
    ]
    return spark.createDataFrame(rows, f"{KO_KEY} string, fold int, feature string, value string, lo double, hi double")


@register("d16_refit_areas")
def d16_refit_areas(spark, folder):
    """The same with the configuration's own settings: no limit on rules or conditions."""
    counts = refit.refit_counts(spark, refitted(spark, folder, learn.LearnSettings()))
    return rounded(roc.mean_area(roc.fold_rates(counts)), "mean_auc", "std_auc")


@register("j11_metrics_of_refits", with_parts(f"""
SELECT m.ko_activity, m.support, m.confidence, q.precision, q.recall, q.f1_score, round(a.mean_auc, 6) AS roc_auc,
       round(s.std_auc, 6) AS roc_auc_std, CASE m.ko_activity WHEN 'Check Balance' THEN 2 ELSE 1 END AS rule_count,
       CASE m.ko_activity WHEN 'Check Price' THEN 1 ELSE 2 END AS condition_count,
       'dl_allowance=1, k=2, max_rule_conds=1, max_rules=1, n_discretize_bins=10, prune_size=0.0, seed=0' AS parameters
FROM ({MEASURES}) m JOIN ({QUALITY}) q ON q.ko_activity = m.ko_activity
JOIN (SELECT l.ko_activity, sum((l.mean_tpr + r.mean_tpr) / 2 / 99) AS mean_auc
      FROM rareas l JOIN rareas r ON r.ko_activity = l.ko_activity AND r.point = l.point + 1 GROUP BY 1) a
  ON a.ko_activity = m.ko_activity
JOIN (SELECT ko_activity, stddev_pop(coalesce((1 + tpr - fpr) / 2, 0)) AS std_auc FROM rrates GROUP BY 1) s
  ON s.ko_activity = m.ko_activity"""))
def j11_refits(spark, folder):
    """The metrics table with the parameters of each check and areas from folds."""
    cases, available = order_cases_and_available(spark, folder)
    cases = write_table(cases)
    split = splits.temporal_holdout(cases)
    chosen = {ko: ONE_CONDITION for ko in FIXED_RULES}
    table = rules.rule_metrics(
        split, split.filter("is_test"), FIXED_RULES, available,
        settings={ko: asdict(own) for ko, own in chosen.items()},
        areas=refit.refit_areas(cases, chosen, FEATURES, "IREP"),
    )
    table = rounded(table, "support", "confidence", "precision", "recall", "f1_score", "roc_auc", "roc_auc_std")
    return table.drop("predicted", "predicted_true")


# --- variant comparison -------------------------------------------------------------------------

@register("c7_transition_difference", with_parts("""
SELECT a AS activity, b AS next_activity, count(*) AS variants_having, (SELECT count(*) FROM day_variants) - count(*) AS variants_lacking
FROM day_uses GROUP BY 1, 2"""))
def c7(spark, folder):
    rows, table = day_variant_rows(spark, folder)
    total = table.agg(F.count(F.lit(1))).scalar()
    having = rows.filter(F.col("next_activity").isNotNull()).groupBy(ACTIVITY, "next_activity").agg(
        F.count_distinct("vidx").alias("variants_having")
    )
    return having.withColumn("variants_lacking", total - F.col("variants_having"))


@register("e3_next_value_filled", with_parts("""
SELECT case_id, seq, last_value(nxt IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY end_ts, seq
       ROWS UNBOUNDED PRECEDING) AS next_value FROM (
  SELECT case_id, seq, end_ts, lead(c_acctbal) OVER (PARTITION BY case_id ORDER BY end_ts, seq) AS nxt FROM ord)"""))
def e3(spark, folder):
    from casegate.operators.ordered import forward_fill, sequence

    log = sequence(orders(spark, folder), BY_END, leads={"nxt": "c_acctbal"})
    return forward_fill(log, BY_END, {"next_value": "nxt"}).select(CASE, "seq", "next_value")


@register("h4_case_frequency_text", with_parts("""
SELECT ko_activity, CAST(round(100 * available_cases / (SELECT count(*) FROM day_labels), 2) AS VARCHAR) || ' %' AS frequency_text
FROM available"""))
def h4_frequency(spark, folder):
    data = day_labelled(spark, folder)
    table = metrics.case_frequencies(data.base, data.kos)
    return table.select(KO_KEY, percent(F.col("case_frequency") / 100).alias("frequency_text"))
