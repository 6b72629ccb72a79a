"""The registered queries once more, as plain SQL over the same tables.

``PARTS`` are named common table expressions in dependency order; each query
lists the parts it needs and adds its own SELECT.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}

PARTS["raw_day"] = """
SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS case_id, event_id AS seq, event_type AS activity,
       'R' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS resource,
       ts AS start_ts, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS end_ts,
       CAST(floor(value * 60) AS BIGINT) * 1000000 AS duration_us,
       value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events"""

PARTS["day_edges"] = """
SELECT case_id, min(start_ts) - INTERVAL 1 MICROSECOND AS first_ts, max(end_ts) + INTERVAL 1 MICROSECOND AS last_ts,
       min(seq) - 1 AS low, max(seq) + 1 AS high
FROM raw_day GROUP BY case_id"""

PARTS["day"] = """
SELECT * FROM raw_day
UNION ALL BY NAME
SELECT case_id, low AS seq, 'Start' AS activity, 'Start' AS resource, first_ts AS start_ts, first_ts AS end_ts,
       CAST(0 AS BIGINT) AS duration_us FROM day_edges
UNION ALL BY NAME
SELECT case_id, high AS seq, 'End' AS activity, 'End' AS resource, last_ts AS start_ts, last_ts AS end_ts,
       CAST(0 AS BIGINT) AS duration_us FROM day_edges"""

PARTS["day_next"] = """
SELECT *, lead(activity) OVER w AS next_activity, lead(start_ts) OVER w AS next_start_ts,
       row_number() OVER w - 1 AS position
FROM day WINDOW w AS (PARTITION BY case_id ORDER BY start_ts, seq)"""

PARTS["day_kos"] = """
SELECT DISTINCT activity FROM day_next
WHERE next_activity = 'error' AND activity NOT IN ('error', 'Start', 'End')"""

PARTS["day_rejected"] = "SELECT DISTINCT case_id FROM day WHERE activity = 'error'"

PARTS["day_cut"] = """
SELECT case_id, min((end_ts, seq)) AS cut FROM day WHERE activity = 'error' GROUP BY case_id"""

PARTS["day_labels"] = """
SELECT c.case_id, r.case_id IS NOT NULL AS knocked_out_case,
       CASE WHEN r.case_id IS NOT NULL THEN l.knockout_activity END AS knockout_activity
FROM (SELECT DISTINCT case_id FROM day) c
LEFT JOIN day_rejected r ON r.case_id = c.case_id
LEFT JOIN (
  SELECT d.case_id, arg_max(d.activity, (d.end_ts, d.seq)) AS knockout_activity
  FROM day d LEFT JOIN day_cut k ON k.case_id = d.case_id
  WHERE d.activity IN (SELECT activity FROM day_kos) AND (k.cut IS NULL OR (d.end_ts, d.seq) <= k.cut)
  GROUP BY d.case_id) l ON l.case_id = c.case_id"""

PARTS["dayl"] = """
SELECT d.*, l.knocked_out_case, l.knockout_activity FROM day d JOIN day_labels l ON l.case_id = d.case_id"""

PARTS["kos"] = """
SELECT DISTINCT knockout_activity AS ko_activity FROM day_labels WHERE knockout_activity IS NOT NULL"""

PARTS["available"] = """
SELECT activity AS ko_activity, CAST(count(DISTINCT case_id) AS BIGINT) AS available_cases
FROM day WHERE activity IN (SELECT ko_activity FROM kos) GROUP BY activity"""

PARTS["rates"] = """
SELECT a.ko_activity, a.available_cases, CAST(n.n AS BIGINT) AS knocked_out_cases,
       n.n / a.available_cases AS rejection_rate
FROM available a JOIN (SELECT knockout_activity, count(*) AS n FROM day_labels GROUP BY 1) n
  ON n.knockout_activity = a.ko_activity"""

PARTS["waste"] = """
SELECT knockout_activity AS ko_activity, CAST(sum(work) AS BIGINT) AS processing_waste_us,
       CAST(sum(span) AS BIGINT) AS overprocessing_waste_us
FROM (SELECT knockout_activity, case_id, sum(duration_us) AS work,
             date_diff('microsecond', min(start_ts), max(end_ts)) AS span
      FROM dayl WHERE knockout_activity IS NOT NULL AND activity <> knockout_activity
      GROUP BY 1, 2)
GROUP BY 1"""

PARTS["means"] = """
SELECT activity, avg(date_diff('microsecond', start_ts, end_ts)) / 1000000 AS mean_seconds FROM day GROUP BY 1"""

PARTS["idle"] = """
SELECT d.resource, d.end_ts AS a, d.next_start_ts AS b
FROM day_next d JOIN day_labels l ON l.case_id = d.case_id
WHERE NOT l.knocked_out_case AND d.next_start_ts > d.end_ts"""

PARTS["waits"] = """
SELECT k.ko_activity, CAST(coalesce(sum(w.us), 0) AS BIGINT) AS waiting_waste_us
FROM kos k LEFT JOIN (
  SELECT d.knockout_activity, date_diff('microsecond', greatest(i.a, d.start_ts), least(i.b, d.end_ts)) AS us
  FROM dayl d JOIN idle i ON i.resource = d.resource AND i.a < d.end_ts AND d.start_ts < i.b
  WHERE d.knockout_activity IS NOT NULL) w ON w.knockout_activity = k.ko_activity
GROUP BY 1"""

PARTS["report"] = """
SELECT r.ko_activity, r.available_cases, r.knocked_out_cases, r.rejection_rate, m.mean_seconds,
       m.mean_seconds / (100 * r.rejection_rate) AS effort,
       100 * r.available_cases / (SELECT count(*) FROM day_labels) AS case_frequency,
       w.processing_waste_us, w.overprocessing_waste_us, t.waiting_waste_us,
       t.waiting_waste_us / (SELECT count(*) FROM day_labels WHERE NOT knocked_out_case) AS mean_waiting_waste_us
FROM rates r JOIN means m ON m.activity = r.ko_activity JOIN waste w ON w.ko_activity = r.ko_activity
JOIN waits t ON t.ko_activity = r.ko_activity"""

# --- variants ---------------------------------------------------------------

PARTS["day_seqs"] = """
SELECT case_id, list(activity ORDER BY end_ts, seq) AS v FROM day GROUP BY case_id"""

PARTS["day_variants"] = """
SELECT v, len(v) AS variant_len, count(*) AS case_count, min(case_id) AS first_case,
       row_number() OVER (ORDER BY len(v), count(*) DESC, min(case_id)) - 1 AS vidx
FROM day_seqs GROUP BY v"""

PARTS["day_steps"] = """
SELECT vidx, variant_len, p - 1 AS position, v[p] AS activity, v[p + 1] AS next_activity
FROM (SELECT vidx, variant_len, v, unnest(range(1, variant_len + 1)) AS p FROM day_variants)"""

PARTS["day_uses"] = """
SELECT vidx, activity AS a, next_activity AS b, count(*) AS uses, min(position) AS first_position
FROM day_steps WHERE position < variant_len - 1 GROUP BY 1, 2, 3"""

PARTS["day_best"] = """
SELECT vidx, a AS from_activity, b AS to_activity, CAST(score AS BIGINT) AS score FROM (
  SELECT u.vidx, u.a, u.b, sum(u.uses) AS score,
         row_number() OVER (PARTITION BY u.vidx ORDER BY sum(u.uses) DESC, min(o.vidx), min(u.first_position)) AS r
  FROM day_uses u JOIN day_variants o ON o.vidx <> u.vidx
  WHERE NOT EXISTS (SELECT 1 FROM day_uses x WHERE x.vidx = o.vidx AND x.a = u.a AND x.b = u.b)
  GROUP BY u.vidx, u.a, u.b) WHERE r = 1"""

PARTS["day_second"] = """
SELECT b.vidx, b.to_activity AS activity, min(s.position) AS first_at,
       arg_min(coalesce(s.next_activity, '?'), s.position) AS after, any_value(s.variant_len) AS variant_len
FROM day_best b JOIN day_steps s ON s.vidx = b.vidx AND s.activity = b.to_activity GROUP BY 1, 2"""

PARTS["day_mentions"] = """
SELECT b.vidx, 0 AS slot, b.from_activity AS candidate, b.to_activity AS followed_by FROM day_best b
UNION ALL
SELECT vidx, 1, activity, nullif(after, '?') FROM day_second WHERE first_at <> variant_len - 2"""

PARTS["day_firsts"] = """
SELECT m.*, row_number() OVER (ORDER BY vidx, slot) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY vidx, slot) AS r FROM day_mentions) m WHERE r = 1"""

PARTS["day_stop"] = """
SELECT min(v.vidx) AS stop FROM day_variants v
WHERE v.vidx >= (SELECT min(vidx) FROM day_firsts WHERE rank = LIMIT_)
  AND v.vidx NOT IN (
    SELECT s.vidx FROM day_second s LEFT JOIN day_firsts f ON f.candidate = s.activity
    WHERE s.first_at = s.variant_len - 2 AND (f.vidx IS NULL OR (f.vidx, f.slot) > (s.vidx, 1)))"""

PARTS["day_candidates"] = """
SELECT f.candidate, coalesce(f.followed_by, v.v[-2]) AS followed_by, v.v[-2] AS outcome, v.variant_len, f.vidx, f.rank
FROM day_firsts f JOIN day_variants v ON v.vidx = f.vidx
WHERE (SELECT stop FROM day_stop) IS NULL OR f.vidx <= (SELECT stop FROM day_stop)"""

# --- the order chain ----------------------------------------------------------

PARTS["raw_order"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderkey * 10 + step AS seq, name AS activity,
       'R' || ((o_orderkey + step) % 8) AS resource,
       o_orderdate + to_hours(step) + to_minutes(o_orderkey % 7) AS start_ts,
       o_orderdate + to_hours(step) + to_minutes(o_orderkey % 7) + to_minutes(minutes) AS end_ts,
       minutes * CAST(60000000 AS BIGINT) AS duration_us,
       CASE WHEN step > 2 THEN c_acctbal END AS c_acctbal, o_totalprice, o_orderpriority
FROM (SELECT o.*, c.c_acctbal,
             CASE WHEN c_acctbal < 0 THEN 3 WHEN o_totalprice > 400000 THEN 4
                  WHEN o_orderpriority = '5-LOW' THEN 5 ELSE 99 END AS stop
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) o
JOIN (VALUES (1, 'Receive order', 2), (2, 'Load account', 3), (3, 'Check Balance', 5), (4, 'Check Price', 10),
             (5, 'Check Priority', 20), (6, 'Notify rejection', 1), (6, 'Accept order', 1), (7, 'Close order', 1)
     ) s(step, name, minutes)
  ON (step <= stop OR step >= 6) AND (name <> 'Notify rejection' OR stop < 99) AND (name <> 'Accept order' OR stop = 99)"""

PARTS["order_labels"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id,
       c_acctbal < 0 OR o_totalprice > 400000 OR o_orderpriority = '5-LOW' AS knocked_out_case,
       CASE WHEN c_acctbal < 0 THEN 'Check Balance' WHEN o_totalprice > 400000 THEN 'Check Price'
            WHEN o_orderpriority = '5-LOW' THEN 'Check Priority' END AS knockout_activity
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""

PARTS["order_edges"] = """
SELECT case_id, min(start_ts) - INTERVAL 1 MICROSECOND AS first_ts, max(end_ts) + INTERVAL 1 MICROSECOND AS last_ts,
       min(seq) - 1 AS low, max(seq) + 1 AS high
FROM raw_order GROUP BY case_id"""

PARTS["ord"] = """
SELECT * FROM raw_order
UNION ALL BY NAME
SELECT case_id, low AS seq, 'Start' AS activity, 'Start' AS resource, first_ts AS start_ts, first_ts AS end_ts,
       CAST(0 AS BIGINT) AS duration_us FROM order_edges
UNION ALL BY NAME
SELECT case_id, high AS seq, 'End' AS activity, 'End' AS resource, last_ts AS start_ts, last_ts AS end_ts,
       CAST(0 AS BIGINT) AS duration_us FROM order_edges"""

PARTS["ordl"] = """
SELECT d.*, l.knocked_out_case, l.knockout_activity FROM ord d JOIN order_labels l ON l.case_id = d.case_id"""


def needed(text: str, parts: dict[str, str]) -> list[str]:
    """Names of the parts a text uses, directly or not, in definition order."""
    wanted: set[str] = set()
    pending = [text]
    while pending:
        current = pending.pop()
        for name, body in parts.items():
            if name not in wanted and re.search(rf"\b{name}\b", current):
                wanted.add(name)
                pending.append(body)
    return [name for name in parts if name in wanted]


def with_parts(select: str, **values) -> str:
    """A complete statement: the parts it needs, then the SELECT."""
    used = needed(select, PARTS)
    text = select
    if used:
        text = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in used) + "\n" + select
    for name, value in values.items():
        text = text.replace(name, str(value))
    return text
