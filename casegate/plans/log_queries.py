"""Queries on reading, filtering, discovery, labels and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegate.functions.text import arrow_text, hms, percent, trimmed_list
from casegate.operators import discovery, filters, metrics, prepare, variants, waiting
from casegate.operators.labels import observed_kos
from casegate.operators.names import names_of
from casegate.plans.oracles import with_parts
from casegate.plans.registry import day, day_by_case, day_labelled, orders, orders_labelled, register
from casegate.schema import ACTIVITY, CASE, KO, KO_KEY, REJECTED
from casegate.sources.derived import user_day_log


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- reading and preparation --------------------------------------------------

def visits(spark, folder):
    """Lifecycle rows of all events: a view or signup opens a visit or stay of the user, everything
    else completes one; errors are left without a meaning, as in many logs."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias(CASE),
        F.col("event_id").alias("seq"),
        F.when(kind.isin("view", "click"), "Visit").otherwise("Stay").alias(ACTIVITY),
        F.when(kind.isin("view", "signup"), "start").when(kind != "error", "complete").otherwise("suspend").alias("transition"),
        F.concat(F.lit("R"), F.get_json_object("props", "$.k").cast("long") % 10).alias("resource"),
        "ts",
    )


VISITS = """
WITH rows AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS seq,
         CASE WHEN event_type IN ('view', 'click') THEN 'Visit' ELSE 'Stay' END AS activity,
         CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE 0 END AS o,
         CASE WHEN event_type NOT IN ('view', 'signup', 'error') THEN 1 ELSE 0 END AS c,
         'R' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS resource, ts
  FROM events),
counted AS (
  SELECT *, sum(o) OVER w AS opens, sum(c) OVER w AS closes, sum(o - c) OVER w AS balance
  FROM rows WINDOW w AS (PARTITION BY case_id, activity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
lows AS (
  SELECT *, least(0, min(balance) OVER (PARTITION BY case_id, activity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS low,
         least(0, coalesce(min(balance) OVER (PARTITION BY case_id, activity ORDER BY ts, seq
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low_before
  FROM counted),
starts AS (SELECT case_id, activity, opens AS k, ts, resource FROM lows WHERE o = 1),
completes AS (SELECT *, CASE WHEN low = low_before THEN closes + low END AS k FROM lows WHERE c = 1)
SELECT c.case_id, c.seq, c.activity, CASE WHEN s.ts IS NULL THEN c.resource ELSE s.resource END AS resource,
       coalesce(s.ts, c.ts) AS start_ts, c.ts AS end_ts,
       date_diff('microsecond', coalesce(s.ts, c.ts), c.ts) AS duration_us
FROM completes c LEFT JOIN starts s ON s.case_id = c.case_id AND s.activity = c.activity AND s.k = c.k"""


@register("a2_lifecycle_intervals", VISITS)
def a2(spark, folder):
    return prepare.to_intervals(visits(spark, folder))


RAW_NAMES = """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, 'R' || (user_id % 10) AS resource,
       ts AS end_ts, value FROM events"""


def raw_export(spark, folder):
    """``events`` as an export would name and format it."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("user_id").cast("string").alias("Case ID"),
        F.col("event_type").alias("Activity"),
        F.concat(F.lit("R"), F.col("user_id") % 10).alias("Resource"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Complete Timestamp"),
        "value",
    )


@register("a5_rename_columns", """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, 'R' || (user_id % 10) AS resource,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS end_ts, value FROM events""")
def a5(spark, folder):
    return prepare.rename(raw_export(spark, folder))


@register("a6_drop_attributes", with_parts(
    "SELECT case_id, seq, activity, resource, start_ts, end_ts, duration_us FROM raw_day"))
def a6(spark, folder):
    return prepare.drop_attributes(user_day_log(spark, folder))


@register("a7_parse_timestamps", RAW_NAMES)
def a7(spark, folder):
    return prepare.parse_timestamps(
        prepare.rename(raw_export(spark, folder)), ["end_ts"], "%Y-%m-%dT%H:%M:%S.%f"
    )


@register("a8_drop_native_boundaries", with_parts("SELECT case_id, seq, activity FROM raw_day"))
def a8(spark, folder):
    return prepare.drop_native_boundaries(day(spark, folder)).select(CASE, "seq", ACTIVITY)


@register("a10_deduplicate", "SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem")
def a10(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return prepare.deduplicate(lines.select("l_orderkey", "l_linenumber", "l_suppkey"))


@register("a11_boundary_events", with_parts("SELECT case_id, seq, activity, resource, start_ts, end_ts FROM day"))
def a11(spark, folder):
    return day(spark, folder).select(CASE, "seq", ACTIVITY, "resource", "start_ts", "end_ts")


@register("a12_canonical_log", """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS seq, event_type AS activity,
       'R' || (user_id % 10) AS resource, ts AS start_ts, ts AS end_ts, CAST(0 AS BIGINT) AS duration_us, value
FROM events""")
def a12(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    raw = events.select(
        F.col("user_id").alias(CASE),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias(ACTIVITY),
        F.concat(F.lit("R"), F.col("user_id") % 10).alias("resource"),
        F.col("ts").alias("end_ts"),
        "value",
    )
    return prepare.canonical(raw, one_timestamp=True)


@register("a13_traces", with_parts("SELECT case_id, CAST(position AS BIGINT) AS position, activity, seq FROM day_next"))
def a13(spark, folder):
    return prepare.traces(day(spark, folder)).select(CASE, "position", ACTIVITY, "seq")


@register("a14_written_log", with_parts(
    "SELECT case_id, seq, activity, knocked_out_case, knockout_activity FROM dayl"))
def a14(spark, folder):
    from casegate.lineage import cut_lineage

    log = day_labelled(spark, folder).log
    return cut_lineage(log.select(CASE, "seq", ACTIVITY, REJECTED, KO))


# --- filters --------------------------------------------------------------------

@register("b1_eventually_follows", with_parts("""
SELECT case_id, seq, activity FROM day WHERE case_id IN (
  SELECT x.case_id FROM day_next x JOIN day_next y ON x.case_id = y.case_id AND x.position < y.position
  WHERE (x.activity = 'signup' AND y.activity = 'purchase') OR (x.activity = 'view' AND y.activity = 'click'))"""))
def b1(spark, folder):
    pairs = [("signup", "purchase"), ("view", "click")]
    return filters.eventually_follows(day(spark, folder), pairs).select(CASE, "seq", ACTIVITY)


@register("b1_never_follows", with_parts("""
SELECT case_id, seq, activity FROM day WHERE case_id NOT IN (
  SELECT x.case_id FROM day_next x JOIN day_next y ON x.case_id = y.case_id AND x.position < y.position
  WHERE x.activity = 'signup' AND y.activity = 'purchase')"""))
def b1_not(spark, folder):
    return filters.eventually_follows(day(spark, folder), [("signup", "purchase")], retain=False).select(
        CASE, "seq", ACTIVITY
    )


@register("b2_directly_follows", with_parts("""
SELECT case_id, seq, activity FROM day WHERE case_id IN (
  SELECT case_id FROM day_next WHERE (activity = 'signup' AND next_activity = 'purchase')
     OR (activity = 'view' AND next_activity = 'End'))"""))
def b2(spark, folder):
    pairs = [("signup", "purchase"), ("view", "End")]
    log, whole = day_by_case(spark, folder)
    return filters.directly_follows(log, pairs, whole=whole).select(CASE, "seq", ACTIVITY)


@register("b3_chained_follows", with_parts("""
SELECT case_id, seq, activity FROM day WHERE case_id IN (
  SELECT x.case_id FROM day_next x JOIN day_next y ON x.case_id = y.case_id AND x.position < y.position
  WHERE x.activity = 'view' AND y.activity = 'click')
AND case_id IN (
  SELECT x.case_id FROM day_next x JOIN day_next y ON x.case_id = y.case_id AND x.position < y.position
  WHERE x.activity = 'click' AND y.activity = 'purchase')"""))
def b3(spark, folder):
    return filters.chained_eventually_follows(day(spark, folder), ["view", "click", "purchase"]).select(
        CASE, "seq", ACTIVITY
    )


@register("b4_variant_coverage", with_parts("""
SELECT d.case_id, d.seq, d.activity FROM day d JOIN day_seqs s ON s.case_id = d.case_id
WHERE s.v IN (SELECT v FROM day_variants WHERE case_count >= 0.01 * (SELECT count(*) FROM day_seqs))"""))
def b4(spark, folder):
    log = day(spark, folder)
    _, cases = variants.covered_variants(variants.placed_steps(log), 0.01)
    return filters.keep_cases(log, cases).select(CASE, "seq", ACTIVITY)


@register("b5_exclude_from_kos", with_parts("SELECT activity FROM day_kos WHERE activity <> 'signup'"))
def b5(spark, folder):
    found = discovery.activities_before(day(spark, folder), ["error"])
    return discovery.excluded(found, ACTIVITY, ["Start", "End", "error", "signup"])


@register("b15_passing_cases", with_parts("SELECT case_id, seq FROM dayl WHERE NOT knocked_out_case"))
def b15(spark, folder):
    return day_labelled(spark, folder).log.filter(~F.col(REJECTED)).select(CASE, "seq")


@register("b15_knocked_out_by", with_parts("SELECT case_id, seq FROM dayl WHERE knockout_activity = 'view'"))
def b15_by(spark, folder):
    return day_labelled(spark, folder).log.filter(F.col(KO) == "view").select(CASE, "seq")


@register("b16_case_rows", with_parts(
    "SELECT case_id, min(start_ts) AS start_ts, arg_min(activity, (start_ts, seq)) AS activity FROM raw_day GROUP BY 1"))
def b16(spark, folder):
    from casegate.operators.casetable import case_rows

    return case_rows(user_day_log(spark, folder)).select(CASE, "start_ts", ACTIVITY)


# --- joins ----------------------------------------------------------------------

@register("c3_interval_overlap", with_parts("SELECT * FROM waits"))
def c3(spark, folder):
    data = day_labelled(spark, folder)
    return waiting.waiting_time_waste(data.log, data.kos)


@register("c4_semi_and_anti", with_parts("""
SELECT case_id, seq, knocked_out_case FROM dayl
WHERE case_id NOT IN (SELECT case_id FROM day WHERE activity = 'purchase')"""))
def c4(spark, folder):
    data = day_labelled(spark, folder)
    buyers = data.base.filter(F.col(ACTIVITY) == "purchase")
    return filters.keep_cases(data.log, buyers, retain=False).select(CASE, "seq", REJECTED)


@register("c5_label_events", with_parts("SELECT case_id, seq, activity, knocked_out_case, knockout_activity FROM dayl"))
def c5(spark, folder):
    return day_labelled(spark, folder).log.select(CASE, "seq", ACTIVITY, REJECTED, KO)


# --- metrics --------------------------------------------------------------------

@register("d1_total_cases", with_parts("SELECT count(DISTINCT case_id) AS total_cases FROM day"))
def d1(spark, folder):
    return metrics.total_cases(user_day_log(spark, folder))


@register("d2_available_cases", with_parts("SELECT * FROM available"))
def d2(spark, folder):
    data = day_labelled(spark, folder)
    return metrics.available_cases(data.base, data.kos)


@register("d3_rejection_rate", with_parts(
    "SELECT * REPLACE (round(rejection_rate, 6) AS rejection_rate) FROM rates"))
def d3(spark, folder):
    data = day_labelled(spark, folder)
    return rounded(metrics.rejection_rates(data.base, data.labels, data.kos), "rejection_rate")


@register("d4_processing_waste", with_parts("SELECT ko_activity, processing_waste_us FROM waste"))
def d4(spark, folder):
    data = day_labelled(spark, folder)
    return metrics.processing_waste(data.log, data.kos)


@register("d5_overprocessing_waste", with_parts("SELECT ko_activity, overprocessing_waste_us FROM waste"))
def d5(spark, folder):
    data = day_labelled(spark, folder)
    return metrics.overprocessing_waste(data.log, data.kos)


@register("d6_waiting_time_waste", with_parts("SELECT * FROM waits"))
def d6(spark, folder):
    data = day_labelled(spark, folder)
    return waiting.waiting_time_waste(data.log, data.kos)


@register("d7_mean_duration", with_parts("SELECT activity, round(mean_seconds, 6) AS mean_seconds FROM means"))
def d7(spark, folder):
    return rounded(metrics.mean_durations(day(spark, folder)), "mean_seconds")


@register("d8_effort_per_rejection", with_parts(
    "SELECT ko_activity, round(effort, 6) AS effort, round(mean_seconds, 6) AS mean_seconds FROM report"))
def d8(spark, folder):
    data = day_labelled(spark, folder)
    found = metrics.efforts(data.base, data.labels, data.kos)
    return rounded(found.select(KO_KEY, "effort", "mean_seconds"), "effort", "mean_seconds")


@register("d8_effort_one_timestamp", with_parts(
    "SELECT ko_activity, round(1 / (100 * rejection_rate), 6) AS effort FROM rates"))
def d8_one(spark, folder):
    data = day_labelled(spark, folder)
    found = metrics.efforts(data.base, data.labels, data.kos, one_timestamp=True)
    return rounded(found.select(KO_KEY, "effort"), "effort")


@register("d9_case_frequency", with_parts(
    "SELECT ko_activity, available_cases, round(case_frequency, 6) AS case_frequency FROM report"))
def d9(spark, folder):
    data = day_labelled(spark, folder)
    return rounded(metrics.case_frequencies(data.base, data.kos), "case_frequency")


@register("d10_mean_waiting_waste", with_parts(
    "SELECT ko_activity, round(mean_waiting_waste_us, 3) AS mean_waiting_waste_us FROM report"))
def d10(spark, folder):
    data = day_labelled(spark, folder)
    passed = metrics.passed_cases(data.labels).scalar()
    waste = waiting.waiting_time_waste(data.log, data.kos)
    return waste.select(
        KO_KEY, F.round(F.try_divide("waiting_waste_us", passed), 3).alias("mean_waiting_waste_us")
    )


@register("d11_analysis_report", with_parts("""
SELECT ko_activity, available_cases, knocked_out_cases, round(rejection_rate, 6) AS rejection_rate,
       round(mean_seconds, 6) AS mean_seconds, round(effort, 6) AS effort, round(case_frequency, 6) AS case_frequency,
       processing_waste_us, overprocessing_waste_us, waiting_waste_us,
       round(mean_waiting_waste_us, 3) AS mean_waiting_waste_us FROM report"""))
def d11(spark, folder):
    data = day_labelled(spark, folder)
    table = metrics.report(data.log, data.labels, data.kos)
    table = rounded(table, "rejection_rate", "mean_seconds", "effort", "case_frequency")
    return rounded(table, "mean_waiting_waste_us", digits=3)


@register("d11_report_orders", with_parts("""
SELECT l.knockout_activity AS ko_activity, a.n AS available_cases, count(*) AS knocked_out_cases,
       round(count(*) / a.n, 6) AS rejection_rate
FROM order_labels l JOIN (SELECT activity, count(DISTINCT case_id) AS n FROM ord GROUP BY 1) a
  ON a.activity = l.knockout_activity GROUP BY 1, 2"""))
def d11_orders(spark, folder):
    data = orders_labelled(spark, folder)
    table = metrics.report(data.log, data.labels, data.kos, one_timestamp=True)
    return rounded(table, "rejection_rate").select(
        KO_KEY, "available_cases", "knocked_out_cases", "rejection_rate"
    )


@register("d12_discovery_quality", with_parts("""
SELECT tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
       round((tp + tn) / total, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1_score
FROM (SELECT count(*) AS total,
        count(*) FILTER (activity IN (SELECT activity FROM day_kos) AND activity IN ('view', 'click', 'error')) AS tp,
        count(*) FILTER (activity IN (SELECT activity FROM day_kos) AND activity NOT IN ('view', 'click', 'error')) AS fp,
        count(*) FILTER (activity NOT IN (SELECT activity FROM day_kos) AND activity NOT IN ('view', 'click', 'error')) AS tn,
        count(*) FILTER (activity NOT IN (SELECT activity FROM day_kos) AND activity IN ('view', 'click', 'error')) AS fn
      FROM (SELECT DISTINCT activity FROM day))"""))
def d12(spark, folder):
    log = day(spark, folder)
    found = names_of(
        discovery.excluded(discovery.activities_before(log, ["error"]), ACTIVITY, ["Start", "End"]), ACTIVITY
    )
    quality = metrics.discovery_quality(metrics.distinct_activities(log), ["view", "click", "error"], found)
    return rounded(quality, "accuracy", "precision", "recall", "f1_score")


@register("d19_case_processing_time", with_parts("""
SELECT case_id, CAST(sum(duration_us) AS BIGINT) AS processing_us,
       coalesce(max(knockout_activity), CASE WHEN NOT max(knocked_out_case) THEN 'Not Knocked Out' END) AS outcome_label
FROM dayl GROUP BY 1"""))
def d19(spark, folder):
    return metrics.case_processing_times(day_labelled(spark, folder).log)


@register("d20_processing_time_distribution", with_parts("""
SELECT outcome_label, count(*) AS cases, round(quantile_cont(p, 0.0), 3) AS low, round(quantile_cont(p, 0.25), 3) AS q1,
       round(quantile_cont(p, 0.5), 3) AS median, round(quantile_cont(p, 0.75), 3) AS q3, round(quantile_cont(p, 1.0), 3) AS high
FROM (SELECT case_id, CAST(sum(duration_us) AS DOUBLE) AS p,
        coalesce(max(knockout_activity), CASE WHEN NOT max(knocked_out_case) THEN 'Not Knocked Out' END) AS outcome_label
      FROM dayl GROUP BY 1) GROUP BY 1"""))
def d20(spark, folder):
    by_case = metrics.case_processing_times(day_labelled(spark, folder).log)
    spread = metrics.processing_time_distribution(by_case)
    return rounded(spread, "low", "q1", "median", "q3", "high", digits=3)


@register("d21_cases_per_outcome", with_parts("""
SELECT coalesce(knockout_activity, CASE WHEN NOT knocked_out_case THEN 'Not Knocked Out' END) AS outcome_label,
       count(*) AS cases FROM day_labels GROUP BY 1"""))
def d21(spark, folder):
    return metrics.outcome_counts(metrics.case_processing_times(day_labelled(spark, folder).log))


@register("d26_observed_order", with_parts("""
SELECT knockout_activity AS ko_activity, CAST(floor(avg(p)) AS BIGINT) AS mean_position FROM (
  SELECT n.case_id, l.knockout_activity, min(n.position) AS p
  FROM day_next n JOIN day_labels l ON l.case_id = n.case_id AND l.knockout_activity = n.activity GROUP BY 1, 2)
GROUP BY 1"""))
def d26(spark, folder):
    from casegate.operators.redesign import observed_order

    return observed_order(day_labelled(spark, folder).log)


@register("d27_distinct_activities", with_parts("SELECT DISTINCT activity FROM day"))
def d27(spark, folder):
    return metrics.distinct_activities(day(spark, folder))


# --- windows ----------------------------------------------------------------------

@register("e1_next_activity", with_parts("SELECT case_id, seq, activity, next_activity FROM day_next"))
def e1(spark, folder):
    return filters.next_activity(day(spark, folder)).select(CASE, "seq", ACTIVITY, "next_activity")


@register("e2_idle_intervals", with_parts("SELECT resource, a, b FROM idle"))
def e2(spark, folder):
    found = waiting.idle_intervals(day_labelled(spark, folder).log)
    return found.select("resource", F.col("end_ts").alias("a"), F.col("next_start_ts").alias("b"))


@register("e5_event_position", with_parts("""
SELECT case_id, seq, CAST(row_number() OVER (PARTITION BY case_id ORDER BY end_ts, seq) - 1 AS BIGINT) AS position
FROM day"""))
def e5(spark, folder):
    return prepare.traces(day(spark, folder), one_timestamp=True).select(CASE, "seq", "position")


# --- variants and discovery ---------------------------------------------------------

@register("f1_sorted_variants", with_parts("""
SELECT vidx, variant_len, case_count, first_case, array_to_string(v, ' -> ') AS variant FROM day_variants"""))
def f1(spark, folder):
    steps = variants.placed_steps(day(spark, folder))
    table = variants.sorted_variants(steps)
    shown = variants.variant_arrays(steps, table).select("first_case", arrow_text(F.col("variant")).alias("variant"))
    return table.join(shown, "first_case").select(
        "vidx", F.col("variant_len").cast("long"), "case_count", "first_case", "variant"
    )


@register("g2_union_of_relations", with_parts("""
SELECT DISTINCT case_id FROM day_next
WHERE (activity, next_activity) IN (('view', 'click'), ('click', 'view'), ('signup', 'purchase'))"""))
def g2(spark, folder):
    pairs = [("view", "click"), ("click", "view"), ("signup", "purchase")]
    log, whole = day_by_case(spark, folder)
    return filters.directly_follows_cases(log, pairs, whole)


@register("g3_activity_difference", with_parts("SELECT DISTINCT activity FROM raw_day WHERE activity NOT IN ('error')"))
def g3(spark, folder):
    names = metrics.distinct_activities(user_day_log(spark, folder))
    post = spark.createDataFrame([("error",)], "activity string")
    return names.join(post, ACTIVITY, "left_anti")


@register("g4_known_and_found_kos", with_parts("SELECT activity FROM day_kos UNION SELECT 'view' UNION SELECT 'manual'"))
def g4(spark, folder):
    known = spark.createDataFrame([("view",), ("manual",)], "activity string")
    found = discovery.activities_before(day(spark, folder), ["error"])
    found = discovery.excluded(found, ACTIVITY, ["Start", "End"])
    return found.union(known).distinct()


@register("i2_kos_before_known_outcome", with_parts("SELECT activity FROM day_kos"))
def i2(spark, folder):
    found = discovery.activities_before(day(spark, folder), ["error"])
    return discovery.excluded(found, ACTIVITY, ["Start", "End"])


@register("i2_kos_of_orders", "SELECT unnest(['Check Balance', 'Check Price', 'Check Priority']) AS activity")
def i2_orders(spark, folder):
    return discovery.activities_before(orders(spark, folder), ["Notify rejection"])


@register("i3_unsuccessful_variants", with_parts("""
SELECT len(v) AS variant_len, array_to_string(v, ' -> ') AS variant, count(*) AS case_count FROM day_seqs
WHERE NOT list_contains(v, 'purchase') GROUP BY 1, 2"""))
def i3(spark, folder):
    log = filters.eventually_follows(day(spark, folder), [("Start", "purchase")], retain=False)
    steps = variants.placed_steps(log)
    counted = variants.count_variants(variants.case_variants(steps))
    shown = variants.variant_arrays(steps, counted)
    return shown.select("variant_len", arrow_text(F.col("variant")).alias("variant"), "case_count")


def day_variant_rows(spark, folder):
    steps = variants.placed_steps(day(spark, folder))
    table = variants.sorted_variants(steps)
    return variants.variant_steps(steps, table), table


@register("i4_differentiating_transition", with_parts("SELECT * FROM day_best"))
def i4(spark, folder):
    return discovery.differentiating_transitions(*day_variant_rows(spark, folder))


@register("f2_top_transition_per_variant", with_parts("SELECT vidx, from_activity, to_activity FROM day_best"))
def f2(spark, folder):
    found = discovery.differentiating_transitions(*day_variant_rows(spark, folder))
    return found.select("vidx", "from_activity", "to_activity")


CANDIDATES = "SELECT candidate, followed_by, outcome, variant_len, vidx, rank FROM day_candidates"


@register("i5_candidate_sequences", with_parts(CANDIDATES, LIMIT_=7))
def i5(spark, folder):
    found = discovery.automatic_sequences(day(spark, folder), 7)
    return found.withColumn("variant_len", F.col("variant_len").cast("long"))


@register("f3_candidates_up_to_limit", with_parts(CANDIDATES, LIMIT_=3))
def f3(spark, folder):
    found = discovery.automatic_sequences(day(spark, folder), 3)
    return found.withColumn("variant_len", F.col("variant_len").cast("long"))


@register("i6_automatic_outcomes", with_parts(
    "SELECT outcome, count(*) AS candidates, min(rank) AS first_rank FROM day_candidates GROUP BY 1", LIMIT_=7))
def i6(spark, folder):
    return discovery.automatic_outcomes(discovery.automatic_sequences(day(spark, folder), 7))


@register("i7_rejected_by_outcome", with_parts("SELECT case_id FROM day_rejected"))
def i7(spark, folder):
    from casegate.operators.labels import rejected_cases

    return rejected_cases(day(spark, folder), [], post=["error"])


@register("i7_rejected_without_success", with_parts("""
SELECT DISTINCT case_id FROM day WHERE case_id NOT IN (
  SELECT case_id FROM day WHERE activity IN ('purchase', 'signup'))"""))
def i7_success(spark, folder):
    from casegate.operators.labels import rejected_cases

    return rejected_cases(day(spark, folder), [], success=["purchase", "signup"])


@register("i7_rejected_missing_any_success", with_parts("""
SELECT DISTINCT case_id FROM day WHERE case_id NOT IN (
  SELECT case_id FROM day WHERE activity IN ('purchase', 'signup') GROUP BY 1 HAVING count(DISTINCT activity) = 2)"""))
def i7_any(spark, folder):
    from casegate.operators.labels import rejected_cases

    return rejected_cases(day(spark, folder), [], success=["purchase", "signup"], any_missing=True)


@register("i7_rejected_at_the_end", with_parts("""
SELECT DISTINCT case_id FROM day_next WHERE next_activity = 'End' AND activity IN ('view', 'click')"""))
def i7_end(spark, folder):
    from casegate.operators.labels import rejected_cases

    return rejected_cases(day(spark, folder), ["view", "click"])


@register("i8_case_labels", with_parts("SELECT * FROM day_labels"))
def i8(spark, folder):
    return day_labelled(spark, folder).labels


@register("i8_case_labels_of_orders", with_parts("SELECT * FROM order_labels"))
def i8_orders(spark, folder):
    return orders_labelled(spark, folder).labels


@register("i9_observed_kos", with_parts("SELECT ko_activity FROM kos"))
def i9(spark, folder):
    return observed_kos(day_labelled(spark, folder).labels)


# --- text forms ---------------------------------------------------------------------

@register("h2_shift_one_microsecond", with_parts("SELECT case_id, first_ts, last_ts FROM day_edges"))
def h2(spark, folder):
    edges = day(spark, folder).filter(F.col(ACTIVITY).isin("Start", "End"))
    return edges.groupBy(CASE).agg(
        F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts")
    )


@register("h3_duration_text", """
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN s // 86400 > 0 THEN (s // 86400) || ' days, ' ELSE '' END
  || ((s % 86400) // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration_text
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(floor(l_extendedprice * 7) AS BIGINT) AS s FROM lineitem)""")
def h3(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        hms(F.floor(F.col("l_extendedprice") * 7)).alias("duration_text"),
    )


@register("h4_percent_text", with_parts("""
SELECT ko_activity, CAST(round(100 * rejection_rate, 2) AS VARCHAR) || ' %' AS rejection_text FROM rates"""))
def h4(spark, folder):
    data = day_labelled(spark, folder)
    rates = metrics.rejection_rates(data.base, data.labels, data.kos)
    return rates.select(KO_KEY, percent(F.col("rejection_rate")).alias("rejection_text"))


@register("h5_trimmed_list", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' , ' || p_type || ',' || p_brand, ','),
       lambda x: trim(x)), '|') AS parts FROM part""")
def h5(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    text = F.concat("p_name", F.lit(" , "), "p_type", F.lit(","), "p_brand")
    return part.select("p_partkey", F.array_join(trimmed_list(text), "|").alias("parts"))


@register("h10_variant_text", with_parts(
    "SELECT first_case, array_to_string(v, ' -> ') AS variant FROM day_variants"))
def h10(spark, folder):
    steps = variants.placed_steps(day(spark, folder))
    counted = variants.count_variants(variants.case_variants(steps))
    shown = variants.variant_arrays(steps, counted)
    return shown.select("first_case", arrow_text(F.col("variant")).alias("variant"))
