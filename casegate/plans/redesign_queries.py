"""Queries on redesign options, roles, work in progress and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegate.functions.text import arrow_text
from casegate.lineage import write_table
from casegate.operators import casetable, enrich, metrics, redesign, roles, wip
from casegate.operators.ordered import sequence
from casegate.plans.log_queries import rounded
from casegate.plans.oracles import PARTS, with_parts
from casegate.plans.registry import day, day_labelled, orders, orders_labelled, register
from casegate.plans.rule_queries import FIXED_RULES
from casegate.schema import ACTIVITY, BY_START, CASE, KO_KEY
from casegate.sources.derived import order_log, order_tasks, user_day_log

# --- dependencies, order, relocation ------------------------------------------------

PARTS["oprod"] = """
SELECT d.case_id, l.knockout_activity AS ko_activity, 'c_acctbal' AS feature, arg_min(d.activity, (d.end_ts, d.seq)) AS producer
FROM (SELECT case_id, activity, end_ts, seq, lead(c_acctbal) OVER (PARTITION BY case_id ORDER BY end_ts, seq) AS nxt FROM ord) d
JOIN order_labels l ON l.case_id = d.case_id
JOIN (SELECT case_id, max(c_acctbal) AS final FROM ord GROUP BY 1) f ON f.case_id = d.case_id AND f.final = d.nxt
WHERE l.knockout_activity IS NOT NULL GROUP BY 1, 2"""


@register("k2_attribute_producers", with_parts("SELECT * FROM oprod"))
def k2(spark, folder):
    return redesign.attribute_producers(orders_labelled(spark, folder).log, ["c_acctbal"])


@register("k3_check_dependencies", with_parts("""
SELECT 'Check Balance' AS ko_activity, 'c_acctbal' AS feature, arg_min(producer, (-n, producer)) AS producer
FROM (SELECT producer, count(*) AS n FROM oprod WHERE ko_activity = 'Check Balance' GROUP BY 1)"""))
def k3(spark, folder):
    data = orders_labelled(spark, folder)
    features = spark.createDataFrame([("Check Balance", "c_acctbal")], f"{KO_KEY} string, feature string")
    return redesign.dependencies(data.log, features)


@register("f5_most_frequent_producer", with_parts("""
SELECT ko_activity, producer FROM (
  SELECT ko_activity, producer, row_number() OVER (PARTITION BY ko_activity ORDER BY count(*) DESC, producer) AS r
  FROM oprod GROUP BY 1, 2) WHERE r = 1"""))
def f5(spark, folder):
    data = orders_labelled(spark, folder)
    features = spark.createDataFrame([(k, "c_acctbal") for k in data.kos], f"{KO_KEY} string, feature string")
    return redesign.dependencies(data.log, features).select(KO_KEY, "producer")


@register("k9_dependency_report", with_parts("""
SELECT unnest(['Check Balance', 'Check Price', 'Check Priority']) AS ko_activity,
       unnest(['''c_acctbal'' is known once this is done: ''' || (SELECT arg_min(producer, (-n, producer))
          FROM (SELECT producer, count(*) AS n FROM oprod WHERE ko_activity = 'Check Balance' GROUP BY 1)) || '''',
          'needs nothing that is not known at the start', 'needs nothing that is not known at the start']) AS dependencies"""))
def k9(spark, folder):
    data = orders_labelled(spark, folder)
    features = spark.createDataFrame([("Check Balance", "c_acctbal")], f"{KO_KEY} string, feature string")
    return redesign.dependency_report(redesign.dependencies(data.log, features), data.kos)


PARTS["eff"] = "SELECT ko_activity AS name, effort FROM report"

BEST_ORDER = """
WITH RECURSIVE grown AS (
  SELECT [name] AS ko_order, effort AS score FROM eff
  UNION ALL
  SELECT list_append(g.ko_order, e.name), g.score + (len(g.ko_order) + 1) * e.effort
  FROM grown g JOIN eff e ON NOT list_contains(g.ko_order, e.name))
SELECT array_to_string(ko_order, ',') AS ko_order, round(score, 6) AS score FROM grown
WHERE len(ko_order) = (SELECT count(*) FROM eff) {extra} ORDER BY grown.score DESC, ko_order LIMIT 1"""


def best_order_sql(extra: str = "") -> str:
    return _recursive(BEST_ORDER.format(extra=extra))


def _recursive(text: str) -> str:
    """The parts and the recursive expression share one WITH clause."""
    head, tail = with_parts(text.strip()).split("\nWITH RECURSIVE ", 1)
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + tail


def day_efforts(spark, folder):
    data = day_labelled(spark, folder)
    table = metrics.efforts(data.base, data.labels, data.kos)
    return {r[KO_KEY]: r["effort"] for r in table.select(KO_KEY, "effort").collect()}


def shown_order(found):
    return found.select(F.array_join("ko_order", ",").alias("ko_order"), F.round("score", 6).alias("score"))


@register("k4_optimal_order", best_order_sql())
def k4(spark, folder):
    return shown_order(redesign.optimal_order(spark, day_efforts(spark, folder)))


@register("f4_best_allowed_permutation", best_order_sql(
    "AND list_position(ko_order, 'view') < list_position(ko_order, 'signup')"))
def f4(spark, folder):
    efforts = day_efforts(spark, folder)
    return shown_order(redesign.optimal_order(spark, efforts, {"signup": [("value", "view")]}))


@register("k5_cases_following_order", with_parts("""
SELECT (SELECT count(DISTINCT x.case_id) FROM day_next x JOIN day_next y ON y.case_id = x.case_id AND x.position < y.position
        JOIN day_labels l ON l.case_id = x.case_id
        WHERE x.activity = 'view' AND y.activity = 'click' AND NOT l.knocked_out_case) AS cases_respecting_order,
       (SELECT count(*) FROM day_labels WHERE NOT knocked_out_case) AS total_cases"""))
def k5(spark, folder):
    return redesign.cases_following(day_labelled(spark, folder).log, ["view", "click"])


ORDER = ["Check Priority", "Check Balance", "Check Price"]
NEEDS = {"Check Balance": [("c_acctbal", "Load account")]}

PARTS["reloc"] = """
SELECT case_count, array_to_string(v, ' -> ') AS as_is,
       array_to_string(list_concat(['Start'], CASE WHEN list_contains(v, 'Check Priority') THEN ['Check Priority'] ELSE [] END,
         ['Receive order', 'Load account'], ['Check Balance'],
         CASE WHEN list_contains(v, 'Check Price') THEN ['Check Price'] ELSE [] END,
         [v[-3]], ['Close order', 'End']), ' -> ') AS to_be
FROM (SELECT v, count(*) AS case_count FROM (
        SELECT case_id, list(activity ORDER BY end_ts, seq) AS v FROM ord GROUP BY 1) GROUP BY 1)
WHERE case_count >= 0.001 * (SELECT count(*) FROM order_labels)"""


@register("k6_relocated_checks", with_parts("SELECT case_count, as_is, to_be FROM reloc"))
def k6(spark, folder):
    found = redesign.relocation(write_table(orders(spark, folder)), ORDER, NEEDS)
    return found.select(
        "case_count", arrow_text(F.col("as_is")).alias("as_is"), arrow_text(F.col("to_be")).alias("to_be")
    )


@register("k7_relocation_report", with_parts("""
SELECT case_count, CAST(round(100 * case_count / (SELECT count(*) FROM order_labels), 1) AS VARCHAR) || ' %' AS cases_covered,
       as_is, to_be FROM reloc"""))
def k7(spark, folder):
    log = write_table(orders(spark, folder))
    total = log.agg(F.count_distinct(CASE)).scalar()
    found = redesign.relocation_report(redesign.relocation(log, ORDER, NEEDS), total)
    return found.select("case_count", "cases_covered", "as_is", "to_be")


@register("k11_redesign_options")
def k11(spark, folder):
    """Every option as rows: ``option, what, how``."""
    from casegate.plans.analysis import redesign_options

    data = orders_labelled(spark, folder)
    efforts = metrics.efforts(data.base, data.labels, data.kos)
    cases = casetable.case_table(data.base, data.labels)
    found = redesign_options(data.log, efforts, FIXED_RULES, cases)
    rows = None
    for option, table in sorted(found.items()):
        shown = [arrow_text(F.col(c)) if t.startswith("array<string>") else F.col(f"`{c}`").cast("string") for c, t in table.dtypes]
        one = table.select(F.lit(option).alias("option"), shown[0].alias("what"), F.concat_ws(" | ", *shown[1:]).alias("how"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def hms_sql(us: str) -> str:
    """Report text of microseconds."""
    clock = f"(({us} // 1000000) % 86400 // 3600) || ':' || lpad(CAST(({us} // 1000000) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({us} // 1000000) % 60 AS VARCHAR), 2, '0')"
    return f"CASE WHEN {us} // 86400000000 > 0 THEN ({us} // 86400000000) || ' days, ' ELSE '' END || {clock}"


@register("f7_report_in_order", with_parts(f"""
SELECT ko_activity AS "Knockout Check", available_cases AS "Total frequency", round(effort, 2) AS "Effort per rejection",
       {hms_sql('waiting_waste_us')} AS "Total Waiting Time Waste" FROM report"""))
def f7(spark, folder):
    data = day_labelled(spark, folder)
    table = metrics.report_text(metrics.report(data.log, data.labels, data.kos))
    return table.select("Knockout Check", "Total frequency", "Effort per rejection", "Total Waiting Time Waste")


# --- roles ------------------------------------------------------------------------------

PARTS["freqs"] = """
SELECT resource, activity, count(*) AS freq FROM raw_day WHERE resource IS NOT NULL AND resource <> 'AUTO' GROUP BY 1, 2"""

PARTS["corr_pairs"] = """
SELECT x.resource AS x, y.resource AS y,
       (t.t * sum(x.freq * y.freq) - any_value(nx.s * ny.s)) /
       sqrt(CAST(any_value(t.t * nx.q - nx.s * nx.s) AS DOUBLE) * any_value(t.t * ny.q - ny.s * ny.s)) AS correlation
FROM freqs x JOIN freqs y ON y.activity = x.activity AND x.resource < y.resource
JOIN (SELECT resource, sum(freq) AS s, sum(freq * freq) AS q FROM freqs GROUP BY 1) nx ON nx.resource = x.resource
JOIN (SELECT resource, sum(freq) AS s, sum(freq * freq) AS q FROM freqs GROUP BY 1) ny ON ny.resource = y.resource
CROSS JOIN (SELECT count(DISTINCT activity) AS t FROM freqs) t GROUP BY x.resource, y.resource, t.t"""

LEVEL = 0.5  # threshold of the registered role queries

ROLES = f"""
WITH RECURSIVE reach AS (
  SELECT DISTINCT resource AS a, resource AS b FROM freqs
  UNION
  SELECT r.a, e.b FROM reach r JOIN (
    SELECT x AS a, y AS b FROM corr_pairs WHERE correlation > {LEVEL}
    UNION ALL SELECT y, x FROM corr_pairs WHERE correlation > {LEVEL}) e ON e.a = r.b),
comp AS (SELECT a AS resource, min(b) AS component FROM reach GROUP BY 1),
sized AS (SELECT component, count(*) AS quantity, row_number() OVER (ORDER BY count(*) DESC, min(resource)) AS i FROM comp GROUP BY 1),
dayroles AS (SELECT c.resource, 'Role ' || s.i AS role, s.quantity FROM comp c JOIN sized s ON s.component = c.component)
"""


def roles_sql(select: str, extra: str = "") -> str:
    return _recursive(ROLES.rstrip() + extra + "\n" + select)


def day_roles(spark, folder):
    return roles.discover_roles(user_day_log(spark, folder), LEVEL)


@register("l1_resource_task_frequency", with_parts("SELECT * FROM freqs"))
def l1(spark, folder):
    return roles.task_frequencies(day(spark, folder))


@register("l2_profile_correlation", with_parts("SELECT x, y, round(correlation, 6) AS correlation FROM corr_pairs"))
def l2(spark, folder):
    return rounded(roles.profile_correlations(roles.task_frequencies(day(spark, folder))), "correlation")


@register("c6_similar_profiles", with_parts(f"SELECT x, y FROM corr_pairs WHERE correlation > {LEVEL}"))
def c6(spark, folder):
    frequencies = roles.task_frequencies(day(spark, folder))
    return roles.profile_correlations(frequencies, LEVEL).select("x", "y")


@register("l3_roles", roles_sql("SELECT resource, role, quantity FROM dayroles"))
def l3(spark, folder):
    return day_roles(spark, folder)


@register("c1_user_roles", roles_sql(
    "SELECT d.case_id, d.seq, r.role FROM day d LEFT JOIN dayroles r ON r.resource = d.resource"))
def c1(spark, folder):
    return roles.with_roles(day(spark, folder), day_roles(spark, folder)).select(CASE, "seq", "role")


DOMINANT = """
SELECT activity, role FROM (SELECT d.activity, r.role, row_number() OVER (PARTITION BY d.activity ORDER BY count(*) DESC, r.role) AS k
  FROM day d JOIN dayroles r ON r.resource = d.resource GROUP BY 1, 2) WHERE k = 1"""


@register("f6_dominant_role_per_task", roles_sql(DOMINANT))
def f6(spark, folder):
    return roles.dominant_roles(roles.with_roles(day(spark, folder), day_roles(spark, folder)))


@register("l4_role_members", roles_sql("SELECT role, quantity, resource FROM dayroles"))
def l4(spark, folder):
    return roles.role_members(day_roles(spark, folder))


# --- work in progress ---------------------------------------------------------------------

# Resource halves as roles: fixed by name, so the states do not depend on role discovery.
PARTS["dayr"] = """
SELECT *, CASE WHEN resource IN ('R0', 'R1', 'R2') THEN 'Front' WHEN resource IN ('Start', 'End') THEN NULL ELSE 'Back' END AS role FROM day"""

PARTS["dayrn"] = """
SELECT *, lead(activity) OVER w AS n_task, lead(role) OVER w AS n_role FROM dayr
WINDOW w AS (PARTITION BY case_id ORDER BY start_ts, seq)"""

PARTS["deltas"] = """
SELECT 'cases' AS series, start_ts AS t, CASE activity WHEN 'Start' THEN 1 WHEN 'End' THEN -1 ELSE 0 END AS delta FROM dayr
UNION ALL SELECT 'cases', end_ts, 0 FROM dayr
UNION ALL SELECT 'task ' || activity, start_ts, 1 FROM dayr WHERE role IS NOT NULL
UNION ALL SELECT 'task ' || activity, end_ts, -1 FROM dayr WHERE role IS NOT NULL
UNION ALL SELECT 'role ' || role, start_ts, 1 FROM dayr WHERE role IS NOT NULL
UNION ALL SELECT 'role ' || role, end_ts, -1 FROM dayr WHERE role IS NOT NULL
UNION ALL SELECT 'role ' || n_role, end_ts, 0 FROM dayrn WHERE n_role IS NOT NULL AND role IS NOT NULL"""

PARTS["statesat"] = """
SELECT series, t, CAST(sum(sum(delta)) OVER (PARTITION BY series ORDER BY t) AS BIGINT) AS state FROM deltas GROUP BY 1, 2"""

PARTS["rsize"] = "SELECT role, count(DISTINCT resource) AS n FROM dayr WHERE role IS NOT NULL GROUP BY 1"


def day_with_roles(spark, folder):
    front = F.col("resource").isin("R0", "R1", "R2")
    edge = F.col("resource").isin("Start", "End")
    return day(spark, folder).withColumn("role", F.when(front, "Front").when(~edge, "Back"))


@register("g1_transition_rows", with_parts("""
SELECT case_id, seq, start_ts AS ts, 'start' AS transition FROM day
UNION ALL SELECT case_id, seq, end_ts, 'complete' FROM day"""))
def g1(spark, folder):
    return wip.transitions(day(spark, folder)).select(CASE, "seq", "ts", "transition")


@register("e6_running_state", with_parts("SELECT series, epoch_us(t) AS t, state FROM statesat"))
def e6(spark, folder):
    log = sequence(write_table(day_with_roles(spark, folder)), BY_START, leads={"n_role": "role"})
    return wip.states(wip.state_steps(log))


PARTS["marks"] = """
SELECT case_id, seq, 'st_wip' AS slot, 'cases' AS series, start_ts AS t,
       CASE activity WHEN 'Start' THEN 1 WHEN 'End' THEN -1 ELSE 0 END AS delta FROM dayrn
UNION ALL SELECT case_id, seq, 'end_wip', 'cases', end_ts, 0 FROM dayrn
UNION ALL SELECT case_id, seq, 'st_tsk_wip', 'task ' || activity, start_ts, 1 FROM dayrn WHERE role IS NOT NULL
UNION ALL SELECT case_id, seq, NULL, 'task ' || activity, end_ts, -1 FROM dayrn WHERE role IS NOT NULL
UNION ALL SELECT case_id, seq, 'st_busy', 'role ' || role, start_ts, 1 FROM dayrn WHERE role IS NOT NULL
UNION ALL SELECT case_id, seq, NULL, 'role ' || role, end_ts, -1 FROM dayrn WHERE role IS NOT NULL
UNION ALL SELECT case_id, seq, 'end_busy', 'role ' || n_role, end_ts, 0 FROM dayrn WHERE n_role IS NOT NULL"""

PARTS["reads"] = """
SELECT case_id, seq, slot, sum(delta) OVER (PARTITION BY series ORDER BY t) AS state FROM marks"""

PARTS["wip"] = """
SELECT case_id, seq, CAST(max(state) FILTER (slot = 'st_wip') AS BIGINT) AS st_wip,
       CAST(max(state) FILTER (slot = 'end_wip') AS BIGINT) AS end_wip,
       CAST(max(state) FILTER (slot = 'st_tsk_wip') AS BIGINT) AS st_tsk_wip,
       max(state) FILTER (slot = 'st_busy') AS st_busy, max(state) FILTER (slot = 'end_busy') AS end_busy
FROM reads WHERE slot IS NOT NULL GROUP BY ALL"""

WIP_SQL = """
SELECT d.case_id, d.seq, d.n_task, d.n_role, w.st_wip, w.end_wip, w.st_tsk_wip,
       round(w.st_busy / rs.n, 6) AS rp_st_oc, round(coalesce(w.end_busy / ms.n, 0), 6) AS rp_end_oc
FROM dayrn d JOIN wip w ON w.seq = d.seq AND w.case_id = d.case_id
LEFT JOIN rsize rs ON rs.role = d.role LEFT JOIN rsize ms ON ms.role = d.n_role
WHERE d.activity NOT IN ('Start', 'End')"""


@register("l5_wip_features", with_parts(WIP_SQL))
def l5(spark, folder):
    found = wip.wip_features(write_table(day_with_roles(spark, folder)))
    found = found.select(
        CASE, "seq", "n_task", "n_role", "st_wip", "end_wip", "st_tsk_wip", "rp_st_oc", "rp_end_oc"
    )
    return rounded(found, "rp_st_oc", "rp_end_oc")


@register("c2_state_at_event", with_parts(f"SELECT case_id, seq, st_wip, st_tsk_wip FROM ({WIP_SQL})"))
def c2(spark, folder):
    found = wip.wip_features(write_table(day_with_roles(spark, folder)))
    return found.select(CASE, "seq", "st_wip", "st_tsk_wip")


@register("e4_next_task_and_role", with_parts(
    "SELECT case_id, seq, n_task, n_role FROM dayrn WHERE activity NOT IN ('Start', 'End')"))
def e4(spark, folder):
    log = sequence(day_with_roles(spark, folder), BY_START, leads={"n_task": ACTIVITY, "n_role": "role"})
    return log.filter(~F.col(ACTIVITY).isin("Start", "End")).select(CASE, "seq", "n_task", "n_role")


PARTS["poolstates"] = """
SELECT s.role, x.t, x.state / s.n AS busy FROM statesat x JOIN rsize s ON x.series = 'role ' || s.role"""


@register("l5_role_pool_columns", with_parts("""
SELECT d.case_id, d.seq, round(coalesce(fs.busy, 0), 6) AS front_st_oc, round(coalesce(fe.busy, 0), 6) AS front_end_oc,
       round(coalesce(bs.busy, 0), 6) AS back_st_oc, round(coalesce(be.busy, 0), 6) AS back_end_oc
FROM (SELECT *, 'Front' AS f, 'Back' AS b FROM dayr WHERE activity NOT IN ('Start', 'End')) d
ASOF LEFT JOIN poolstates fs ON fs.role = d.f AND d.start_ts >= fs.t
ASOF LEFT JOIN poolstates fe ON fe.role = d.f AND d.end_ts >= fe.t
ASOF LEFT JOIN poolstates bs ON bs.role = d.b AND d.start_ts >= bs.t
ASOF LEFT JOIN poolstates be ON be.role = d.b AND d.end_ts >= be.t"""))
def l5_pool(spark, folder):
    log = write_table(day_with_roles(spark, folder))
    every = ["Back", "Front"]
    starts = wip.role_pool(log, every).select(CASE, "seq", "front_st_oc", "back_st_oc")
    ends = wip.role_pool(log, every, at_end=True).select(CASE, "seq", "front_end_oc", "back_end_oc")
    return rounded(starts.join(ends, [CASE, "seq"]), "front_st_oc", "back_st_oc", "front_end_oc", "back_end_oc")


PARTS["times"] = "SELECT t, count(*) OVER () AS n, row_number() OVER (ORDER BY t DESC) AS later FROM (SELECT DISTINCT t FROM deltas)"


@register("l6_mean_states", with_parts("""
SELECT d.series, round(sum(d.delta * t.later) / any_value(t.n), 6) AS mean_state
FROM deltas d JOIN times t ON t.t = d.t WHERE NOT d.series LIKE 'role %' GROUP BY 1"""))
def l6(spark, folder):
    return rounded(wip.mean_states(write_table(day_with_roles(spark, folder))), "mean_state")


@register("h1_calendar_features", with_parts("""
SELECT case_id, seq, CAST(extract('hour' FROM start_ts) * 3600 + extract('minute' FROM start_ts) * 60 + extract('second' FROM start_ts) AS INTEGER) AS st_daytime,
       CAST(isodow(start_ts) - 1 AS INTEGER) AS st_weekday, CAST(month(start_ts) AS INTEGER) AS st_month,
       CAST(extract('hour' FROM end_ts) * 3600 + extract('minute' FROM end_ts) * 60 + extract('second' FROM end_ts) AS INTEGER) AS end_daytime,
       CAST(isodow(end_ts) - 1 AS INTEGER) AS end_weekday, CAST(month(end_ts) AS INTEGER) AS end_month
FROM raw_day"""))
def h1(spark, folder):
    return wip.calendar_features(user_day_log(spark, folder)).select(
        CASE, "seq", "st_daytime", "st_weekday", "st_month", "end_daytime", "end_weekday", "end_month"
    )


@register("l7_calendar_only", with_parts("""
SELECT case_id, seq, CAST(isodow(start_ts) - 1 AS INTEGER) AS st_weekday, CAST(month(start_ts) AS INTEGER) AS st_month FROM raw_order"""))
def l7(spark, folder):
    return wip.calendar_features(order_log(spark, folder), both_ends=False).select(
        CASE, "seq", "st_weekday", "st_month"
    )


# --- enrichment ------------------------------------------------------------------------------

@register("m1_runtime_attribute_mask", with_parts("""
SELECT d.case_id, d.seq, CASE WHEN p.done IS NULL OR d.start_ts >= p.done THEN d.value END AS value FROM raw_day d
LEFT JOIN (SELECT case_id, arg_min(end_ts, (start_ts, seq)) AS done FROM raw_day WHERE activity = 'signup' GROUP BY 1) p
  ON p.case_id = d.case_id"""))
def m1(spark, folder):
    return enrich.mask_until(user_day_log(spark, folder), {"value": "signup"}).select(CASE, "seq", "value")


@register("m2_fixed_attributes", with_parts("""
SELECT case_id, seq, CASE WHEN knockout_activity = 'view' AND CAST('0x' || substr(md5(case_id), 1, 4) AS BIGINT) % 2 = 0
       THEN 5000.0 ELSE 4000.0 END::DOUBLE AS debt,
       NOT coalesce(knockout_activity = 'view' AND CAST('0x' || substr(md5(case_id), 1, 4) AS BIGINT) % 2 = 1, false) AS vehicle
FROM dayl"""))
def m2(spark, folder):
    base = {"debt": 4000.0, "vehicle": True}
    rejected = {"view": ({"debt": 5000.0}, {"vehicle": False})}
    return enrich.fixed_attributes(day_labelled(spark, folder).log, base, rejected).select(
        CASE, "seq", "debt", "vehicle"
    )


@register("n2_named_preprocessor", with_parts("""
SELECT case_id, seq, 0.1::DOUBLE AS external, 0.2::DOUBLE AS aggregated FROM ordl"""))
def n2(spark, folder):
    step = enrich.PREPROCESSORS["enrich_log_for_ko_order_advanced_test"]
    return orders_labelled(spark, folder).log.transform(step).select(
        CASE, "seq", F.col("External Risk Score").alias("external"), F.col("Aggregated Risk Score").alias("aggregated")
    )


@register("n6_full_analysis")
def n6(spark, folder):
    from casegate.config import AnalysisConfig
    from casegate.plans.analysis import Analysis

    config = AnalysisConfig(post_knockout_activities=["Notify rejection"], rule_discovery_algorithm="IREP")
    return Analysis(config).run(orders(spark, folder), order_tasks(spark, folder)).report
