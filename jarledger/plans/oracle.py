"""DuckDB oracle SQL for the registered queries.

Every statement starts from the same binding of the driver tables (binding E
of FIXTURES.md) written in plain SQL, independently of the Spark code, and
restates each operator the direct way (correlated re-scans, recursive walks)
rather than the way the Spark plan computes it.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2024-01-25'"

BINDING = r"""
WITH
profiles AS (
  SELECT c.c_custkey AS id, c.c_name AS full_name,
         lower(c.c_name) || '@example.test' AS email,
         CASE n.n_regionkey WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'UAH' WHEN 3 THEN 'GBP' END AS home_currency,
         CASE n.n_regionkey WHEN 0 THEN 'de' WHEN 2 THEN 'uk' ELSE 'en' END AS language
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
transactions AS (
  SELECT event_id AS id,
         user_id * 10 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                                         WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS box_id,
         CAST(CASE WHEN event_id % 4 = 0 THEN -value ELSE value END AS DECIMAL(12,2)) AS amount,
         CASE event_id % 3 WHEN 0 THEN 'note ' || CAST(event_id % 10 AS VARCHAR) WHEN 1 THEN '' END AS note,
         ts AS date
  FROM events
),
box_templates AS (
  SELECT p_partkey AS id, p_name AS name, CAST(floor(p_retailprice) AS INTEGER) AS total_amount,
         'UAH' AS currency,
         CAST(list_transform(range(0, p_size % 20 + 1),
              lambda i: [5, 10, 20, 50, 100, 200, 500][((i + p_partkey) % 7) + 1]) AS INTEGER[]) AS grid_config
  FROM part
),
box_keys AS (
  SELECT c_custkey, c_name, c_custkey * 10 + k AS id, k
  FROM (SELECT c_custkey, c_name, unnest(range(0, 5)) AS k FROM customer)
),
box_sums AS (SELECT box_id, sum(amount) AS s FROM transactions GROUP BY box_id),
user_boxes AS (
  SELECT b.id, b.c_custkey AS user_id,
         CASE WHEN b.id % 3 = 0 THEN b.c_custkey END AS template_id,
         b.c_name || '/' || CAST(b.k AS VARCHAR) AS name,
         CASE b.id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'UAH' WHEN 3 THEN 'GBP'
                       WHEN 4 THEN NULL ELSE 'PLN' END AS currency,
         CAST(CASE WHEN b.id % 7 = 0 THEN 0
                   ELSE greatest(0, coalesce(s.s, 0) + CASE WHEN b.id % 5 = 0 THEN 100 ELSE 0 END) END
              AS DECIMAL(12,2)) AS current_amount,
         CAST(CASE b.id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 100 + b.id % 900 END AS DECIMAL(12,2)) AS target_amount,
         b.id % 8 = 0 AS is_archived,
         CAST(CASE WHEN b.id % 3 = 0 THEN list_filter(range(0, 10), lambda i: (b.id + i) % 3 = 0) ELSE [] END AS INTEGER[])
           AS crossed_out_indices,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(b.id) AS created_at
  FROM box_keys b LEFT JOIN box_sums s ON s.box_id = b.id
),
uah_feed(pos, cc, rate) AS (VALUES (0, 'EUR', CAST(45.0 AS DOUBLE)), (1, 'USD', CAST(41.5 AS DOUBLE)),
                                   (2, 'GBP', CAST(52.5 AS DOUBLE))),
cross_feed(base, quote, rate) AS (VALUES ('EUR', 'USD', CAST(1.08 AS DOUBLE)), ('EUR', 'GBP', CAST(0.86 AS DOUBLE)),
                                         ('USD', 'EUR', CAST(0.925 AS DOUBLE)), ('USD', 'GBP', CAST(0.795 AS DOUBLE)),
                                         ('GBP', 'EUR', CAST(1.165 AS DOUBLE)), ('GBP', 'USD', CAST(1.26 AS DOUBLE))),
rates AS (
  SELECT 'UAH' AS base, cc AS quote, CAST(1 AS DOUBLE) / rate AS rate FROM uah_feed
   WHERE cc IN ('EUR', 'USD', 'GBP') AND (SELECT count(DISTINCT cc) FROM uah_feed WHERE cc IN ('EUR','USD','GBP') AND rate > 0) = 3
  UNION ALL SELECT 'UAH', 'UAH', CAST(1 AS DOUBLE)
   WHERE (SELECT count(DISTINCT cc) FROM uah_feed WHERE cc IN ('EUR','USD','GBP') AND rate > 0) = 3
  UNION ALL SELECT base, quote, rate FROM cross_feed
  UNION ALL SELECT b, b, CAST(1 AS DOUBLE) FROM (VALUES ('EUR'), ('USD'), ('GBP')) t(b)
  UNION ALL SELECT cc, 'UAH', rate FROM uah_feed WHERE cc IN ('EUR', 'USD', 'GBP') AND rate > 0
),
op_log AS (
  SELECT event_id AS op_id, ts, 'd' || CAST(user_id % 8 AS VARCHAR) AS device, user_id AS box_id,
         CASE WHEN event_type = 'purchase' THEN 'withdraw' WHEN event_type = 'error' THEN 'delete_tx'
              WHEN event_type = 'signup' AND event_id % 40 = 0 THEN 'reset' ELSE 'add' END AS op,
         CAST(value AS DECIMAL(12,2)) AS amount, event_id % 997 = 0 AS failed
  FROM events
)
"""

Q: dict[str, str] = {}

# Series, restated as the app computes them: every point re-scans the box's rows.
WEEK = f"""
, wk_spine AS (
  SELECT b.id AS box_id, b.current_amount AS cur, CAST(g AS DATE) AS day
  FROM user_boxes b, unnest(generate_series({AS_OF} - 6, {AS_OF}, INTERVAL 1 DAY)) t(g)
),
wk AS (
  SELECT sp.box_id,
         CAST(sp.day - ({AS_OF} - 6) AS BIGINT) AS point,
         sp.day,
         strftime(sp.day, '%a') AS label,
         CAST(CASE WHEN sp.day = {AS_OF} THEN sp.cur
              ELSE greatest(0, sp.cur - coalesce((SELECT sum(t.amount) FROM transactions t
                                                  WHERE t.box_id = sp.box_id AND CAST(t.date AS DATE) >= {AS_OF} - 6), 0))
                   + coalesce((SELECT sum(t.amount) FROM transactions t
                               WHERE t.box_id = sp.box_id AND CAST(t.date AS DATE) >= {AS_OF} - 6
                                 AND CAST(t.date AS DATE) <= sp.day), 0)
              END AS DECIMAL(18,2)) AS balance
  FROM wk_spine sp
)
"""

MONTH = f"""
, mo_spine AS (
  SELECT b.id AS box_id, b.current_amount AS cur, CAST(g AS DATE) AS day
  FROM user_boxes b, unnest(generate_series({AS_OF} - 29, {AS_OF}, INTERVAL 1 DAY)) t(g)
),
mo AS (
  SELECT sp.box_id,
         CAST(sp.day - ({AS_OF} - 29) AS BIGINT) AS point,
         sp.day,
         CAST(day(sp.day) AS VARCHAR) AS label,
         CAST(CASE WHEN sp.day = {AS_OF} THEN sp.cur
              ELSE greatest(0, sp.cur - coalesce((SELECT sum(t.amount) FROM transactions t
                                                  WHERE t.box_id = sp.box_id AND CAST(t.date AS DATE) >= {AS_OF} - 29), 0))
                   + coalesce((SELECT sum(t.amount) FROM transactions t
                               WHERE t.box_id = sp.box_id AND CAST(t.date AS DATE) >= {AS_OF} - 29
                                 AND CAST(t.date AS DATE) <= sp.day), 0)
              END AS DECIMAL(18,2)) AS balance
  FROM mo_spine sp
)
"""

ALL = f"""
, al_days AS (SELECT DISTINCT box_id, CAST(date AS DATE) AS day FROM transactions),
al_pts AS (
  SELECT d.box_id, d.day, b.current_amount AS cur,
         (SELECT sum(t.amount) FROM transactions t WHERE t.box_id = d.box_id AND CAST(t.date AS DATE) <= d.day) AS run,
         row_number() OVER (PARTITION BY d.box_id ORDER BY d.day) - 1 AS point,
         max(d.day) OVER (PARTITION BY d.box_id) AS last_day
  FROM al_days d JOIN user_boxes b ON b.id = d.box_id
),
al AS (
  SELECT box_id, CAST(point AS BIGINT) AS point, day, strftime(day, '%-d %b') AS label,
         CAST(CASE WHEN day = last_day AND day = {AS_OF} THEN cur ELSE run END AS DECIMAL(18,2)) AS balance
  FROM al_pts
  UNION ALL
  SELECT b.id, CAST(p.point AS BIGINT), {AS_OF}, p.label,
         CAST(CASE WHEN p.point = 0 THEN 0 ELSE b.current_amount END AS DECIMAL(18,2))
  FROM user_boxes b, (VALUES (0, 'Start'), (1, 'Now')) p(point, label)
  WHERE b.current_amount <> 0 AND NOT EXISTS (SELECT 1 FROM transactions t WHERE t.box_id = b.id)
)
"""

CHART = """
, chart AS (
  SELECT b.id AS box_id,
         CASE WHEN CAST(b.target_amount AS DOUBLE) > 0
              THEN greatest(CAST(b.target_amount AS DOUBLE), greatest(coalesce(m.peak, CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE)))
              ELSE CAST(ceil(greatest(greatest(coalesce(m.peak, CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
                             * CAST(1.1 AS DOUBLE)) AS DOUBLE) END AS ceiling
  FROM user_boxes b LEFT JOIN (SELECT box_id, max(CAST(balance AS DOUBLE)) AS peak FROM wk GROUP BY box_id) m
    ON m.box_id = b.id
)
"""

UAH_USERS = "(SELECT id FROM profiles WHERE home_currency = 'UAH')"

Q["ledger_scan"] = """
SELECT t.id, t.box_id, t.amount, t.note, t.date FROM transactions t
WHERE EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id)
"""

# The binding writes every 50th queue dump as malformed JSON (the bad-payload
# case of O03); such dumps yield no rows, so the oracle leaves them out.
Q["op_log_ingest"] = """
SELECT 'd' || CAST(user_id % 8 AS VARCHAR) AS device, event_id AS dump_id, CAST(0 AS BIGINT) AS seq,
       CASE WHEN event_type = 'purchase' THEN 'withdraw' ELSE 'add' END AS action,
       user_id AS box_id, CAST(value AS DECIMAL(12,2)) AS amount,
       CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(event_id % 10 AS VARCHAR) END AS note,
       date_trunc('millisecond', ts) AS ts
FROM events WHERE event_id % 50 <> 0
"""

Q["ledger_snapshot"] = "SELECT id, box_id, amount, note, date FROM transactions"

Q["template_seed"] = """
, seed(id, name, total_amount, currency, grid_config) AS (VALUES
  (CAST(-1000 AS BIGINT), 'Скарбничка 1000 грн', 1000, 'UAH',
   [5, 10, 20, 50, 5, 10, 20, 50, 100, 200, 50, 20, 10, 5, 5, 10, 20, 50, 100, 200, 50, 20]),
  (CAST(-5000 AS BIGINT), 'Скарбничка 5000 грн', 5000, 'UAH',
   [50, 100, 200, 500, 50, 100, 200, 500, 50, 100, 200, 500, 50, 100, 200, 500, 1000])),
cat AS (
  SELECT id, name, total_amount, currency, grid_config FROM box_templates
  UNION ALL
  SELECT id, name, total_amount, currency, grid_config FROM seed WHERE id NOT IN (SELECT id FROM box_templates)
)
SELECT id, name, total_amount, currency, CAST(len(grid_config) AS BIGINT) AS cells,
       CAST(coalesce(list_sum(grid_config), 0) AS BIGINT) AS grid_sum
FROM cat
"""

Q["profile_provision"] = """
SELECT c_custkey AS id, lower(c_name) || '@example.test' AS email,
       CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 3 IN (0, 1) THEN c_name END AS full_name
FROM customer
"""

Q["active_boxes"] = """
SELECT id, user_id, name, currency, current_amount FROM user_boxes WHERE NOT coalesce(is_archived, false)
"""

Q["archived_boxes"] = """
SELECT id, user_id, name, currency, current_amount AS balance FROM user_boxes WHERE coalesce(is_archived, false)
"""

Q["owner_boxes"] = f"""
SELECT id, user_id, name, current_amount FROM user_boxes WHERE user_id IN {UAH_USERS}
"""

Q["box_transactions"] = """
SELECT t.* FROM transactions t WHERE t.box_id IN (SELECT id FROM user_boxes WHERE target_amount > 0)
"""

Q["tx_validate"] = """
SELECT id, box_id, amount, nullif(trim(note), '') AS note, date, reason IS NULL AS accepted, reason
FROM (SELECT *, CASE WHEN box_id IS NULL THEN 'missing_box' WHEN amount IS NULL THEN 'missing_amount'
                     WHEN amount = 0 THEN 'zero_amount' END AS reason FROM transactions)
"""

Q["tx_validate_rejects"] = """
, broken AS (
  SELECT id, CASE WHEN id % 7 <> 0 THEN box_id END AS box_id,
         CAST(CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 0 ELSE amount END AS DECIMAL(12,2)) AS amount, note, date
  FROM transactions
)
SELECT id, box_id, amount, nullif(trim(note), '') AS note, date, reason IS NULL AS accepted, reason
FROM (SELECT *, CASE WHEN box_id IS NULL THEN 'missing_box' WHEN amount IS NULL THEN 'missing_amount'
                     WHEN amount = 0 THEN 'zero_amount' END AS reason FROM broken)
"""

Q["entry_validate"] = """
, typed AS (
  SELECT user_id AS box_id, CASE WHEN event_type = 'purchase' THEN 'withdraw' ELSE 'add' END AS mode,
         CAST(value AS DECIMAL(12,2)) AS v, event_id % 6 AS k
  FROM events
)
SELECT box_id, mode, CAST(CASE WHEN k IN (0, 1) AND v > 0 THEN CASE WHEN mode = 'withdraw' THEN -v ELSE v END END
                          AS DECIMAL(12,2)) AS amount,
       CASE WHEN k = 1 THEN 'hi' END AS note, k IN (0, 1) AND v > 0 AS accepted
FROM typed
"""

Q["box_normalise"] = """
, req AS (
  SELECT c_custkey, c_acctbal,
         CASE WHEN c_custkey % 10 = 0 THEN '   ' ELSE '  ' || c_mktsegment || ' goal ' END AS name,
         CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' usd ' WHEN 2 THEN '' WHEN 3 THEN 'gbp' ELSE 'Uah ' END AS currency
  FROM customer
)
SELECT c_custkey AS request_id, c_custkey AS user_id, trim(name) AS name,
       upper(coalesce(nullif(trim(currency), ''), 'EUR')) AS currency,
       CAST(0 AS DECIMAL(12,2)) AS current_amount,
       CASE WHEN CAST(c_acctbal AS DECIMAL(12,2)) > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS target_amount,
       false AS is_archived, CAST(0 AS BIGINT) AS crossed_cells
FROM req WHERE trim(name) <> ''
"""

Q["boxes_with_template"] = """
SELECT b.id, b.template_id, b.name, b.created_at, t.name AS template_name, t.total_amount AS template_total,
       t.currency AS template_currency, array_to_string(t.grid_config, ',') AS template_grid
FROM user_boxes b LEFT JOIN box_templates t ON t.id = b.template_id
"""

Q["tx_owner_scope"] = f"""
SELECT t.* FROM transactions t
WHERE EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id AND b.user_id IN {UAH_USERS})
"""

Q["box_home_equivalent"] = """
, hb AS (
  SELECT b.id AS box_id, b.user_id, upper(coalesce(nullif(b.currency, ''), 'EUR')) AS code,
         upper(coalesce(b.currency, 'EUR')) AS shown_code, p.home_currency,
         CAST(b.current_amount AS DOUBLE) AS bal
  FROM user_boxes b LEFT JOIN profiles p ON p.id = b.user_id
),
he AS (
  SELECT hb.*, CASE WHEN home_currency IS NULL THEN NULL
                    WHEN code = home_currency THEN bal
                    WHEN r.rate IS NULL OR r.rate = 0 THEN NULL
                    ELSE bal / r.rate END AS home_equivalent
  FROM hb LEFT JOIN rates r ON r.base = hb.home_currency AND r.quote = hb.code
)
SELECT box_id, user_id, code AS currency, home_currency, home_equivalent,
       home_currency IS NOT NULL AND shown_code <> home_currency AND home_equivalent IS NOT NULL AS shown
FROM he
"""

Q["cascade_delete"] = """
SELECT id, box_id, amount FROM transactions t
WHERE NOT EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id
                  AND (b.is_archived OR b.user_id IN (SELECT id FROM profiles WHERE home_currency IS NULL)))
"""

Q["fk_violations"] = """
SELECT 'box_profile' AS kind, id AS child_id, user_id AS parent_id FROM user_boxes b
 WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM profiles p WHERE p.id = b.user_id)
UNION ALL
SELECT 'box_template', id, template_id FROM user_boxes b
 WHERE template_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM box_templates t WHERE t.id = b.template_id)
UNION ALL
SELECT 'tx_box', id, box_id FROM transactions t
 WHERE box_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id)
"""

Q["cascade_delete_boxes"] = """
SELECT id, user_id, name FROM user_boxes
WHERE NOT is_archived AND user_id NOT IN (SELECT id FROM profiles WHERE home_currency IS NULL)
"""

Q["cascade_delete_profiles"] = "SELECT id, full_name, home_currency FROM profiles WHERE home_currency IS NOT NULL"

Q["fk_violations_orphans"] = """
SELECT 'box_profile' AS kind, id AS child_id, user_id AS parent_id FROM user_boxes b
 WHERE NOT is_archived AND NOT EXISTS (SELECT 1 FROM profiles p WHERE p.id = b.user_id AND p.home_currency IS NOT NULL)
UNION ALL
SELECT 'box_template', id, template_id FROM user_boxes b
 WHERE NOT is_archived AND template_id IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM box_templates t WHERE t.id = b.template_id AND t.total_amount >= 1000)
UNION ALL
SELECT 'tx_box', id, box_id FROM transactions t
 WHERE NOT EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id AND NOT is_archived)
"""

Q["boxes_without_activity"] = """
SELECT id, user_id, name, current_amount FROM user_boxes b
WHERE NOT EXISTS (SELECT 1 FROM transactions t WHERE t.box_id = b.id)
"""

Q["balance_fold"] = f"""
SELECT b.id, CAST(b.current_amount + coalesce(s.s, 0) AS DECIMAL(18,2)) AS current_amount,
       coalesce(s.last, b.created_at) AS updated_at, CAST(coalesce(s.n, 0) AS BIGINT) AS n_inserted
FROM user_boxes b LEFT JOIN (
  SELECT box_id, sum(amount) AS s, max(date) AS last, count(*) AS n FROM transactions
  WHERE CAST(date AS DATE) > {AS_OF} GROUP BY box_id) s ON s.box_id = b.id
"""

Q["goal_progress"] = """
, g AS (
  SELECT b.id AS box_id, b.current_amount,
         CAST(coalesce(b.target_amount, CAST(t.total_amount AS DECIMAL(12,2)), 0) AS DECIMAL(18,2)) AS target
  FROM user_boxes b LEFT JOIN box_templates t ON t.id = b.template_id
)
SELECT box_id, target,
       CASE WHEN CAST(target AS DOUBLE) > 0
            THEN least(CAST(current_amount AS DOUBLE) / CAST(target AS DOUBLE), CAST(1 AS DOUBLE))
            ELSE CAST(0 AS DOUBLE) END AS progress,
       CAST(target AS DOUBLE) > 0 AND current_amount >= target AS is_full,
       CAST(CASE WHEN CAST(target AS DOUBLE) > 0
                 THEN floor(least(CAST(current_amount AS DOUBLE) / CAST(target AS DOUBLE) * CAST(100 AS DOUBLE),
                                  CAST(100 AS DOUBLE)) + CAST(0.5 AS DOUBLE))
                 ELSE 0 END AS BIGINT) AS percent
FROM g
"""

Q["grid_fill"] = """
, gf AS (
  SELECT b.id AS box_id, b.template_id, t.total_amount, t.grid_config AS grid,
         list_distinct(list_filter(coalesce(b.crossed_out_indices, CAST([] AS INTEGER[])),
                                   lambda i: i >= 0 AND i < len(t.grid_config))) AS v
  FROM user_boxes b JOIN box_templates t ON t.id = b.template_id
),
gs AS (
  SELECT box_id, template_id, total_amount, CAST(len(grid) AS BIGINT) AS cells,
         CAST(coalesce(list_sum(grid), 0) AS BIGINT) AS grid_sum,
         CAST(len(v) AS BIGINT) AS crossed_cells,
         CAST(coalesce(list_sum(list_transform(v, lambda i: grid[i + 1])), 0) AS BIGINT) AS crossed_sum
  FROM gf
)
SELECT box_id, template_id, cells, grid_sum, crossed_cells, crossed_sum, grid_sum - crossed_sum AS remaining_sum,
       CAST(total_amount AS BIGINT) AS template_total
FROM gs
"""

Q["net_saved_month"] = """
SELECT b.user_id, CAST(coalesce(sum(t.amount), 0) AS DECIMAL(18,2)) AS net_saved
FROM user_boxes b LEFT JOIN transactions t ON t.box_id = b.id AND CAST(t.date AS DATE) >= DATE '2024-01-01'
GROUP BY b.user_id
"""

Q["net_saved_month_by_currency"] = """
SELECT b.user_id, upper(coalesce(b.currency, 'EUR')) AS currency,
       CAST(coalesce(sum(t.amount), 0) AS DECIMAL(18,2)) AS net_saved
FROM user_boxes b LEFT JOIN transactions t ON t.box_id = b.id AND CAST(t.date AS DATE) >= DATE '2024-01-01'
GROUP BY b.user_id, upper(coalesce(b.currency, 'EUR'))
"""

Q["ledger_reconcile"] = """
SELECT coalesce(b.id, s.box_id) AS box_id,
       CAST(b.current_amount AS DECIMAL(18,2)) AS stored,
       CAST(coalesce(s.s, 0) AS DECIMAL(18,2)) AS tx_sum,
       CAST(b.current_amount - coalesce(s.s, 0) AS DECIMAL(18,2)) AS drift,
       CAST(CASE WHEN b.current_amount - coalesce(s.s, 0) > 0 THEN b.current_amount - coalesce(s.s, 0) ELSE 0 END
            AS DECIMAL(18,2)) AS opening
FROM user_boxes b FULL JOIN (SELECT box_id, sum(amount) AS s FROM transactions GROUP BY box_id) s ON s.box_id = b.id
"""

Q["ledger_reconcile_orphans"] = Q["ledger_reconcile"].replace(
    "FROM user_boxes b FULL JOIN", "FROM (SELECT * FROM user_boxes WHERE NOT is_archived) b FULL JOIN")

Q["balance_week"] = WEEK + "SELECT * FROM wk"
Q["balance_month"] = MONTH + "SELECT * FROM mo"
Q["balance_all"] = ALL + "SELECT * FROM al"
Q["chart_scale"] = WEEK + CHART + "SELECT * FROM chart"

Q["axis_labels"] = ALL + """
SELECT box_id, point, label,
       CASE WHEN cnt <= 5 OR point % CAST(ceil(cnt / 5) AS BIGINT) = 0 THEN label ELSE '' END AS axis_label
FROM (SELECT *, count(*) OVER (PARTITION BY box_id) AS cnt FROM al)
"""

Q["axis_labels_month"] = MONTH + """
SELECT box_id, point, label,
       CASE WHEN cnt <= 6 OR point % CAST(ceil(cnt / 6) AS BIGINT) = 0 THEN label ELSE '' END AS axis_label
FROM (SELECT *, count(*) OVER (PARTITION BY box_id) AS cnt FROM mo)
"""

Q["series_normalised"] = WEEK + CHART + """
SELECT w.box_id, w.point, CAST(w.balance AS DOUBLE) / c.ceiling AS norm,
       greatest(CAST(2 AS DOUBLE),
                CAST(w.balance AS DOUBLE)
                / greatest(max(CAST(w.balance AS DOUBLE)) OVER (PARTITION BY w.box_id), CAST(1 AS DOUBLE))
                * CAST(20 AS DOUBLE)) AS bar_height
FROM wk w JOIN chart c ON c.box_id = w.box_id
"""

RECENT = """
, recent AS (
  SELECT id, box_id, amount, note, date, rank FROM (
    SELECT t.*, row_number() OVER (PARTITION BY box_id ORDER BY date DESC, id DESC) AS rank
    FROM transactions t WHERE box_id IN (SELECT id FROM user_boxes WHERE NOT coalesce(is_archived, false)))
  WHERE rank <= 10
)
"""

Q["recent_activity"] = RECENT + "SELECT * FROM recent"

Q["archive_history"] = """
SELECT id, box_id, amount, note, date, rank FROM (
  SELECT t.*, row_number() OVER (PARTITION BY box_id ORDER BY date DESC, id DESC) AS rank
  FROM transactions t WHERE box_id IN (SELECT id FROM user_boxes WHERE coalesce(is_archived, false)))
WHERE rank <= 15
"""

Q["first_activity"] = "SELECT box_id, min(CAST(date AS DATE)) AS first_day FROM transactions GROUP BY box_id"
Q["active_days"] = "SELECT DISTINCT box_id, CAST(date AS DATE) AS day FROM transactions"

BLOCKED = """EXISTS (SELECT 1 FROM op_log f WHERE f.failed AND f.device = o.device
                      AND (f.ts < o.ts OR (f.ts = o.ts AND f.op_id <= o.op_id)))"""

Q["pending_union"] = f"""
SELECT CAST(id AS VARCHAR) AS id, box_id, amount, note, date, false AS pending FROM transactions
UNION ALL
SELECT 'offline_' || CAST(op_id AS VARCHAR), box_id,
       CASE WHEN op = 'withdraw' THEN -abs(amount) ELSE abs(amount) END, CAST(NULL AS VARCHAR), ts, true
FROM (SELECT * FROM op_log WHERE op IN ('add', 'withdraw')) o
WHERE {BLOCKED.replace("FROM op_log f WHERE", "FROM op_log f WHERE f.op IN ('add', 'withdraw') AND")}
"""

Q["op_signing"] = """
SELECT op_id, box_id, op, CASE WHEN op = 'withdraw' THEN -abs(amount) ELSE abs(amount) END AS signed_amount
FROM op_log WHERE op IN ('add', 'withdraw')
"""

Q["drain_until_failure"] = f"SELECT op_id, device, NOT {BLOCKED} AS posted FROM op_log o"

Q["ordered_replay"] = """
, op_once AS (SELECT * FROM op_log QUALIFY row_number() OVER (PARTITION BY op_id ORDER BY ts) = 1),
ops AS (SELECT box_id, op, amount, row_number() OVER (PARTITION BY box_id ORDER BY ts, op_id) AS rn FROM op_once),
walk AS (
  SELECT box_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DECIMAL(18,2)) AS bal, CAST(0 AS BIGINT) AS applied
  FROM (SELECT DISTINCT box_id FROM ops)
  UNION ALL
  SELECT w.box_id, o.rn,
         CAST(CASE WHEN o.op = 'reset' THEN 0
                   WHEN o.amount IS NULL THEN w.bal
                   WHEN o.op = 'add' AND o.amount <> 0 THEN w.bal + abs(o.amount)
                   WHEN o.op = 'withdraw' AND o.amount <> 0 AND w.bal >= abs(o.amount) THEN w.bal - abs(o.amount)
                   WHEN o.op = 'delete_tx' THEN greatest(0, w.bal - o.amount)
                   ELSE w.bal END AS DECIMAL(18,2)),
         w.applied + CASE WHEN o.op = 'reset'
                            OR (o.amount IS NOT NULL AND ((o.op = 'add' AND o.amount <> 0)
                                OR (o.op = 'withdraw' AND o.amount <> 0 AND w.bal >= abs(o.amount))
                                OR o.op = 'delete_tx')) THEN 1 ELSE 0 END
  FROM walk w JOIN ops o ON o.box_id = w.box_id AND o.rn = w.rn + 1
)
SELECT box_id, bal AS final_balance, rn AS n_ops, applied AS n_applied, rn - applied AS n_rejected
FROM walk w WHERE rn = (SELECT max(rn) FROM ops o WHERE o.box_id = w.box_id)
"""

Q["replay_steps"] = """
, op_once AS (SELECT * FROM op_log QUALIFY row_number() OVER (PARTITION BY op_id ORDER BY ts) = 1),
ops AS (SELECT box_id, op_id, op, amount, row_number() OVER (PARTITION BY box_id ORDER BY ts, op_id) AS rn
        FROM op_once),
walk AS (
  SELECT box_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS op_id, CAST(0 AS DECIMAL(18,2)) AS bal,
         CAST(NULL AS BOOLEAN) AS applied
  FROM (SELECT DISTINCT box_id FROM ops)
  UNION ALL
  SELECT w.box_id, o.rn, o.op_id,
         CAST(CASE WHEN o.op = 'reset' THEN 0
                   WHEN o.amount IS NULL THEN w.bal
                   WHEN o.op = 'add' AND o.amount <> 0 THEN w.bal + abs(o.amount)
                   WHEN o.op = 'withdraw' AND o.amount <> 0 AND w.bal >= abs(o.amount) THEN w.bal - abs(o.amount)
                   WHEN o.op = 'delete_tx' THEN greatest(0, w.bal - o.amount)
                   ELSE w.bal END AS DECIMAL(18,2)),
         o.op = 'reset' OR (o.amount IS NOT NULL AND ((o.op = 'add' AND o.amount <> 0)
             OR (o.op = 'withdraw' AND o.amount <> 0 AND w.bal >= abs(o.amount))
             OR o.op = 'delete_tx'))
  FROM walk w JOIN ops o ON o.box_id = w.box_id AND o.rn = w.rn + 1
)
SELECT op_id, box_id, bal AS balance, applied FROM walk WHERE rn > 0
"""

Q["box_attribute_merge"] = """
, aops AS (
  SELECT event_id AS op_id, ts, user_id * 10 + event_id % 5 AS box_id,
         CASE event_type WHEN 'click' THEN 'rename' WHEN 'view' THEN 'retarget' WHEN 'purchase' THEN 'archive'
                         WHEN 'signup' THEN 'restore' ELSE 'recolor' END AS op,
         CASE WHEN event_type = 'click' THEN
                CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' Goal ' || CAST(event_id % 10 AS VARCHAR) || ' ' END
              WHEN event_type = 'view' THEN
                CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 11 = 0 THEN '-5'
                     ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END END AS arg
  FROM events
),
valid AS (
  SELECT *,
         op = 'rename' AND coalesce(trim(arg), '') <> '' AS is_rename,
         op = 'retarget' AND (arg IS NULL OR trim(arg) = '' OR TRY_CAST(trim(arg) AS DECIMAL(12,2)) >= 0) AS is_retarget,
         op IN ('archive', 'restore') AS is_flag,
         row_number() OVER (PARTITION BY box_id, op ORDER BY ts DESC, op_id DESC) AS rn_any
  FROM aops
),
last_name AS (
  SELECT box_id, trim(arg) AS new_name FROM (
    SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY ts DESC, op_id DESC) AS rn FROM valid WHERE is_rename)
  WHERE rn = 1
),
last_target AS (
  SELECT box_id, CASE WHEN arg IS NULL OR trim(arg) = '' THEN NULL ELSE TRY_CAST(trim(arg) AS DECIMAL(12,2)) END AS new_target
  FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY ts DESC, op_id DESC) AS rn FROM valid WHERE is_retarget)
  WHERE rn = 1
),
last_flag AS (
  SELECT box_id, op = 'archive' AS new_archived FROM (
    SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY ts DESC, op_id DESC) AS rn FROM valid WHERE is_flag)
  WHERE rn = 1
),
touched AS (
  SELECT box_id, max(ts) AS touched FROM valid
  WHERE (is_rename OR is_retarget OR is_flag) AND op <> 'archive' GROUP BY box_id
)
SELECT b.id, coalesce(n.new_name, b.name) AS name,
       CASE WHEN lt.box_id IS NOT NULL THEN lt.new_target ELSE b.target_amount END AS target_amount,
       coalesce(f.new_archived, b.is_archived) AS is_archived,
       CASE WHEN tc.touched IS NULL OR tc.touched < b.created_at THEN b.created_at ELSE tc.touched END AS updated_at
FROM user_boxes b
LEFT JOIN last_name n ON n.box_id = b.id
LEFT JOIN last_target lt ON lt.box_id = b.id
LEFT JOIN last_flag f ON f.box_id = b.id
LEFT JOIN touched tc ON tc.box_id = b.id
"""

Q["profile_edit"] = """
, edits AS (
  SELECT event_id AS edit_id, ts, user_id,
         CASE event_id % 4 WHEN 0 THEN chr(9) || ' ' || chr(10)
                           WHEN 1 THEN '  Name ' || CAST(event_id % 10 AS VARCHAR) || chr(9)
                           WHEN 3 THEN 'User ' || CAST(event_id AS VARCHAR) END AS typed
  FROM events
),
newest AS (
  SELECT user_id, nullif(trim(typed, ' ' || chr(9) || chr(10)), '') AS full_name,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, edit_id DESC) AS rn
  FROM edits
)
SELECT p.id, CASE WHEN n.user_id IS NULL THEN p.full_name ELSE n.full_name END AS full_name
FROM profiles p LEFT JOIN newest n ON n.user_id = p.id AND n.rn = 1
"""

Q["box_from_template"] = """
SELECT r.o_orderkey AS request_id, r.o_custkey AS user_id, r.o_orderkey // 7 AS template_id,
       coalesce(nullif(r.name, ''), t.name) AS name, 'EUR' AS currency,
       CAST(0 AS DECIMAL(12,2)) AS current_amount, CAST(NULL AS DECIMAL(12,2)) AS target_amount, false AS is_archived
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE o_orderpriority END AS name FROM orders) r
JOIN box_templates t ON t.id = r.o_orderkey // 7
"""

CROSS = """
, req AS (SELECT event_id AS req_id, ts, user_id * 10 + event_id % 5 AS box_id, CAST(event_id % 25 AS INTEGER) AS idx
          FROM events),
fresh AS (
  SELECT r.*, b.template_id, coalesce(b.crossed_out_indices, CAST([] AS INTEGER[])) AS crossed
  FROM req r JOIN user_boxes b ON b.id = r.box_id
  WHERE NOT list_contains(coalesce(b.crossed_out_indices, CAST([] AS INTEGER[])), r.idx)
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box_id, idx ORDER BY ts, req_id) AS rn FROM fresh)
  WHERE rn = 1
)
"""

Q["crossout_apply"] = CROSS + """
SELECT f.box_id, CAST(t.grid_config[f.idx + 1] AS DECIMAL(12,2)) AS amount,
       'Crossed out index ' || CAST(f.idx AS VARCHAR) AS note, f.ts AS date
FROM firsts f JOIN box_templates t ON t.id = f.template_id
WHERE f.idx >= 0 AND f.idx < len(t.grid_config) AND t.grid_config[f.idx + 1] > 0
"""

Q["crossout_indices"] = CROSS + """
SELECT b.id AS box_id,
       array_to_string(list_concat(coalesce(b.crossed_out_indices, CAST([] AS INTEGER[])), n.added), ',')
         AS crossed_out_indices,
       CAST(len(n.added) AS BIGINT) AS n_added
FROM user_boxes b JOIN (SELECT box_id, list(idx ORDER BY ts, req_id) AS added FROM firsts GROUP BY box_id) n
  ON n.box_id = b.id
"""

Q["tx_delete_apply"] = """
, dels AS (SELECT event_id AS req_id, ts, event_id AS tx_id FROM events WHERE event_type = 'error'),
dfirst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY ts, req_id) AS rn FROM dels) WHERE rn = 1
),
hits AS (
  SELECT t.box_id, d.ts, d.req_id, t.amount FROM dfirst d JOIN transactions t ON t.id = d.tx_id
  WHERE EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id)
),
seq AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY ts, req_id) AS rn FROM hits),
walk AS (
  SELECT b.id AS box_id, CAST(0 AS BIGINT) AS rn, CAST(b.current_amount AS DECIMAL(18,2)) AS bal
  FROM user_boxes b WHERE b.id IN (SELECT box_id FROM hits)
  UNION ALL
  SELECT w.box_id, s.rn, CAST(greatest(0, w.bal - s.amount) AS DECIMAL(18,2))
  FROM walk w JOIN seq s ON s.box_id = w.box_id AND s.rn = w.rn + 1
)
SELECT box_id, bal AS balance, rn AS n_deleted FROM walk w
WHERE rn = (SELECT max(rn) FROM seq s WHERE s.box_id = w.box_id)
"""

Q["activity_feed"] = RECENT + f"""
, labels_dict(language, deposit, withdrawal, today, months) AS (VALUES
  ('en', 'Deposit', 'Withdrawal', 'Today', NULL),
  ('de', 'Einzahlung', 'Auszahlung', 'Heute',
   ['. Jan.', '. Feb.', '. März', '. Apr.', '. Mai', '. Juni', '. Juli', '. Aug.', '. Sept.', '. Okt.', '. Nov.', '. Dez.']),
  ('uk', 'Внесення', 'Зняття', 'Сьогодні',
   [' січ.', ' лют.', ' бер.', ' квіт.', ' трав.', ' черв.', ' лип.', ' серп.', ' вер.', ' жовт.', ' лист.', ' груд.']))
SELECT r.box_id, r.id, r.rank,
       coalesce(nullif(r.note, ''), CASE WHEN r.amount < 0 THEN coalesce(d.withdrawal, 'Withdrawal')
                                         ELSE coalesce(d.deposit, 'Deposit') END) AS label,
       CASE WHEN r.amount < 0 THEN '−' ELSE '+' END AS sign,
       CAST(abs(r.amount) AS VARCHAR) AS amount_text,
       CASE upper(coalesce(b.currency, 'EUR')) WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' WHEN 'UAH' THEN '₴'
            WHEN 'GBP' THEN '£' ELSE upper(coalesce(b.currency, 'EUR')) END AS symbol,
       CAST(r.date AS DATE) = {AS_OF} AS is_today,
       CASE WHEN d.months IS NULL AND CAST(r.date AS DATE) = {AS_OF} THEN 'Today, ' || strftime(r.date, '%I:%M %p')
            WHEN d.months IS NULL THEN strftime(r.date, '%b %-d, %I:%M %p')
            WHEN CAST(r.date AS DATE) = {AS_OF} THEN d.today || strftime(r.date, ', %H:%M')
            ELSE day(r.date) || d.months[month(r.date)] || strftime(r.date, ', %H:%M') END AS time_text
FROM recent r JOIN user_boxes b ON b.id = r.box_id
LEFT JOIN profiles p ON p.id = b.user_id LEFT JOIN labels_dict d ON d.language = p.language
"""


Q["stream_balance_fold"] = """
SELECT box_id, CAST(sum(amount) AS DECIMAL(18,2)) AS balance, max(date) AS updated_at, count(*) AS n_tx
FROM transactions GROUP BY box_id
"""

Q["ordered_replay_ranges"] = Q["ordered_replay"]

Q["tx_delete_remaining"] = """
SELECT id, box_id, amount FROM transactions t
WHERE NOT (id IN (SELECT event_id FROM events WHERE event_type = 'error')
           AND EXISTS (SELECT 1 FROM user_boxes b WHERE b.id = t.box_id))
"""

Q["stream_ordered_replay"] = Q["ordered_replay"]

Q["stream_daily_net"] = """
SELECT box_id, CAST(date AS DATE) AS day, CAST(sum(amount) AS DECIMAL(18,2)) AS net
FROM transactions GROUP BY box_id, CAST(date AS DATE)
"""

Q["home_cards"] = WEEK + RECENT + f"""
, gp AS (
  SELECT b.id AS box_id, b.current_amount,
         CAST(coalesce(b.target_amount, CAST(t.total_amount AS DECIMAL(12,2)), 0) AS DECIMAL(18,2)) AS target
  FROM user_boxes b LEFT JOIN box_templates t ON t.id = b.template_id
),
hb AS (
  SELECT b.id AS box_id, upper(coalesce(nullif(b.currency, ''), 'EUR')) AS code,
         upper(coalesce(b.currency, 'EUR')) AS shown_code, p.home_currency, CAST(b.current_amount AS DOUBLE) AS bal
  FROM user_boxes b LEFT JOIN profiles p ON p.id = b.user_id
),
he AS (
  SELECT hb.*, CASE WHEN home_currency IS NULL THEN NULL WHEN code = home_currency THEN bal
                    WHEN r.rate IS NULL OR r.rate = 0 THEN NULL ELSE bal / r.rate END AS home_equivalent
  FROM hb LEFT JOIN rates r ON r.base = hb.home_currency AND r.quote = hb.code
)
SELECT b.id AS box_id, b.name,
       CASE upper(coalesce(b.currency, 'EUR')) WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' WHEN 'UAH' THEN '₴'
            WHEN 'GBP' THEN '£' ELSE upper(coalesce(b.currency, 'EUR')) END AS symbol,
       CAST(b.current_amount AS DECIMAL(18,2)) AS balance,
       gp.target,
       CASE WHEN CAST(gp.target AS DOUBLE) > 0
            THEN least(CAST(gp.current_amount AS DOUBLE) / CAST(gp.target AS DOUBLE), CAST(1 AS DOUBLE))
            ELSE CAST(0 AS DOUBLE) END AS progress,
       CAST(CASE WHEN CAST(gp.target AS DOUBLE) > 0
                 THEN floor(least(CAST(gp.current_amount AS DOUBLE) / CAST(gp.target AS DOUBLE) * CAST(100 AS DOUBLE),
                                  CAST(100 AS DOUBLE)) + CAST(0.5 AS DOUBLE))
                 ELSE 0 END AS BIGINT) AS percent,
       CAST(gp.target AS DOUBLE) > 0 AND gp.current_amount >= gp.target AS is_full,
       he.home_equivalent,
       he.home_currency IS NOT NULL AND he.shown_code <> he.home_currency AND he.home_equivalent IS NOT NULL AS shown,
       (SELECT max(CAST(w.balance AS DOUBLE)) FROM wk w WHERE w.box_id = b.id) AS week_peak,
       (SELECT count(*) FROM recent r WHERE r.box_id = b.id) AS n_recent,
       (SELECT max(r.date) FROM recent r WHERE r.box_id = b.id) AS last_activity
FROM user_boxes b JOIN gp ON gp.box_id = b.id JOIN he ON he.box_id = b.id
WHERE NOT coalesce(b.is_archived, false)
"""

Q["drain_and_fold"] = """
, q AS (SELECT *, coalesce(failed OR amount IS NULL OR amount = 0, true) AS bad
        FROM op_log WHERE op IN ('add', 'withdraw')),
st AS (
  SELECT q.*, EXISTS (SELECT 1 FROM q f WHERE f.bad AND f.device = q.device
                      AND (f.ts < q.ts OR (f.ts = q.ts AND f.op_id <= q.op_id))) AS blocked
  FROM q
)
SELECT box_id,
       CAST(coalesce(sum(CASE WHEN NOT blocked THEN CASE WHEN op = 'withdraw' THEN -abs(amount) ELSE abs(amount) END END), 0)
            AS DECIMAL(18,2)) AS posted_sum,
       count(*) FILTER (WHERE NOT blocked) AS n_posted,
       count(*) FILTER (WHERE blocked) AS n_kept
FROM st GROUP BY box_id
"""

Q["ledger_snapshot_torn"] = """
SELECT 'box' AS kind, id, current_amount AS amount FROM user_boxes
UNION ALL SELECT 'tx', id, amount FROM transactions
"""

# Item by item: tried from the first fetch that sees it, or from the one that posted the item before it.
DRAIN = """
, qi AS (
  SELECT event_id AS op_id, ts, user_id % 8 AS d, CASE WHEN event_id % 97 = 0 THEN 1 + event_id % 3 ELSE 0 END AS fails FROM events
), qf AS (
  SELECT user_id % 8 AS d, ts, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'
), seq AS (
  SELECT q.*, row_number() OVER (PARTITION BY d ORDER BY ts, op_id) AS k,
         1 + (SELECT count(*) FROM qf WHERE qf.d = q.d AND qf.ts < q.ts) AS a
  FROM qi q
), walk AS (
  SELECT d, k, op_id, fails, a + fails AS round FROM seq WHERE k = 1
  UNION ALL
  SELECT s.d, s.k, s.op_id, s.fails, greatest(s.a, w.round) + s.fails FROM walk w JOIN seq s ON s.d = w.d AND s.k = w.k + 1
), drained AS (
  SELECT w.op_id, 'd' || CAST(w.d AS VARCHAR) AS device, CAST(w.fails AS BIGINT) AS fails, qf.n AS posted_round, qf.ts AS posted_at
  FROM walk w LEFT JOIN qf ON qf.d = w.d AND qf.n = w.round
)
"""
Q["queue_drain_rounds"] = DRAIN + "SELECT * FROM drained"
Q["stream_queue_drain"] = DRAIN + "SELECT op_id, device, posted_round, posted_at FROM drained WHERE posted_round IS NOT NULL"
Q["stream_profile_provision"] = Q["profile_provision"]

# Box by box, op by op, with the rows posted so far; a deletion belongs to its target's box.
UNIFIED = """
, ulog AS (
  SELECT event_id AS op_id, ts, user_id * 10 + event_id % 5 AS box_id,
         CASE WHEN event_type = 'purchase' THEN 'withdraw' WHEN event_type = 'error' THEN 'delete_tx' WHEN event_type = 'click' THEN 'crossout'
              WHEN event_type = 'signup' AND event_id % 40 = 0 THEN 'reset' WHEN event_type = 'signup' AND event_id % 200 = 3 THEN 'delete_box'
              ELSE 'add' END AS op,
         CAST(value AS DECIMAL(12,2)) AS amount,
         CASE event_type WHEN 'error' THEN event_id - 1 - event_id % 7 WHEN 'click' THEN event_id % 25 END AS arg
  FROM events
), homed AS (
  SELECT l.op_id, l.ts, CASE WHEN l.op = 'delete_tx' THEN t.box_id ELSE l.box_id END AS box_id, l.op, abs(l.amount) AS amount, l.arg
  FROM ulog l LEFT JOIN ulog t ON t.op_id = l.arg AND l.op = 'delete_tx'
), steps AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.box_id ORDER BY h.ts, h.op_id) AS n,
         CASE WHEN h.op = 'crossout' AND h.arg < len(tp.grid_config) THEN CAST(tp.grid_config[h.arg + 1] AS DECIMAL(12,2)) ELSE 0 END AS cell
  FROM homed h JOIN user_boxes b ON b.id = h.box_id LEFT JOIN box_templates tp ON tp.id = b.template_id
), walk AS (
  SELECT id AS box_id, CAST(0 AS BIGINT) AS n, CAST(current_amount AS DECIMAL(18,2)) AS bal, CAST(0 AS BIGINT) AS n_applied,
         CAST([] AS STRUCT(id BIGINT, amt DECIMAL(12,2))[]) AS posted, crossed_out_indices AS crossed, false AS deleted
  FROM user_boxes
  UNION ALL
  SELECT w.box_id, s.n,
         CASE WHEN NOT s.ok THEN w.bal WHEN s.op = 'add' THEN w.bal + s.amount WHEN s.op = 'withdraw' THEN w.bal - s.amount
              WHEN s.op = 'reset' THEN 0 WHEN s.op = 'crossout' THEN w.bal + s.cell
              WHEN s.op = 'delete_tx' THEN greatest(0, w.bal - s.hit) ELSE w.bal END,
         w.n_applied + CASE WHEN s.ok AND (s.op IN ('add', 'withdraw', 'reset', 'delete_tx') OR (s.op = 'crossout' AND s.cell > 0)) THEN 1 ELSE 0 END,
         CASE WHEN NOT s.ok THEN w.posted
              WHEN s.op = 'add' OR (s.op = 'crossout' AND s.cell > 0)
              THEN list_append(w.posted, {'id': s.op_id, 'amt': CAST(CASE s.op WHEN 'add' THEN s.amount ELSE s.cell END AS DECIMAL(12,2))})
              WHEN s.op = 'withdraw' THEN list_append(w.posted, {'id': s.op_id, 'amt': CAST(-s.amount AS DECIMAL(12,2))})
              WHEN s.op = 'delete_tx' THEN list_filter(w.posted, lambda p: p.id <> s.arg) ELSE w.posted END,
         CASE WHEN s.ok AND s.op = 'crossout' THEN list_append(w.crossed, CAST(s.arg AS INTEGER)) ELSE w.crossed END,
         w.deleted OR (s.ok AND s.op = 'delete_box')
  FROM walk w JOIN LATERAL (
    SELECT x.*, list_filter(w.posted, lambda p: p.id = x.arg)[1].amt AS hit,
           NOT w.deleted AND CASE x.op WHEN 'add' THEN x.amount <> 0 WHEN 'withdraw' THEN x.amount <> 0 AND w.bal >= x.amount
                                       WHEN 'crossout' THEN NOT list_contains(w.crossed, CAST(x.arg AS INTEGER))
                                       WHEN 'delete_tx' THEN len(list_filter(w.posted, lambda p: p.id = x.arg)) > 0 ELSE true END AS ok
    FROM steps x WHERE x.box_id = w.box_id AND x.n = w.n + 1) s ON true
), done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY n DESC) AS last FROM walk) WHERE last = 1)
"""
Q["unified_replay"] = UNIFIED + """
SELECT box_id, CASE WHEN NOT deleted THEN CAST(bal AS DECIMAL(18,2)) END AS balance, n_applied,
       CASE WHEN NOT deleted THEN array_to_string(crossed, ',') END AS crossed_out_indices, deleted
FROM done
"""
Q["unified_replay_rows"] = UNIFIED + """
SELECT p.id AS op_id, box_id, p.amt AS amount FROM (SELECT box_id, unnest(posted) AS p FROM done WHERE NOT deleted)
"""

Q["net_saved_month_stored"] = Q["net_saved_month"]
Q["net_of_months"] = """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, box_id, CAST(sum(amount) AS DECIMAL(18,2)) AS net FROM transactions
WHERE date_trunc('month', date) IN (SELECT date_trunc('month', created_at) FROM user_boxes WHERE is_archived)
GROUP BY 1, 2
"""

# The cards over balances and transactions that the drained items have moved.
_CARDS = re.sub(r"\buser_boxes\b", "boxes_now", re.sub(r"\btransactions\b", "tx_now", Q["home_cards"]))
Q["open_home"] = DRAIN + """
, sent AS (
  SELECT e.event_id, e.user_id * 10 + e.event_id % 5 AS box_id, e.ts, d.posted_round IS NOT NULL AS posted,
         CAST(CASE WHEN e.event_type = 'purchase' THEN -abs(e.value) ELSE abs(e.value) END AS DECIMAL(12,2)) AS amount
  FROM events e JOIN drained d ON d.op_id = e.event_id
), tx_now AS (
  SELECT * FROM transactions UNION ALL SELECT -event_id, box_id, amount, NULL, ts FROM sent WHERE posted
), boxes_now AS (
  SELECT b.* REPLACE (CAST(b.current_amount + coalesce((SELECT sum(amount) FROM sent s WHERE s.box_id = b.id AND s.posted), 0) AS DECIMAL(12,2)) AS current_amount)
  FROM user_boxes b
)
""" + _CARDS.replace("SELECT b.id AS box_id, b.name,", """SELECT b.id AS box_id, b.name,
       (SELECT count(*) FROM sent s WHERE s.box_id = b.id AND s.posted) AS n_posted,
       (SELECT count(*) FROM sent s WHERE s.box_id = b.id AND NOT s.posted) AS n_waiting,""")

for _key in ("balance_week", "balance_month", "net_saved_month", "recent_activity", "archive_history", "ledger_reconcile"):
    Q[f"sql_{_key}"] = Q[_key]

RECURSIVE = {"ordered_replay", "ordered_replay_ranges", "replay_steps", "tx_delete_apply", "stream_ordered_replay",
             "queue_drain_rounds", "stream_queue_drain", "open_home", "unified_replay", "unified_replay_rows"}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, v in Q.items():
        head = BINDING.replace("WITH", "WITH RECURSIVE", 1) if k in RECURSIVE else BINDING
        out[k] = head + v
    return out
