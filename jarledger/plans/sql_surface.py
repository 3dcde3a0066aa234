"""The ledger in SQL: views of its tables, and table functions for its questions.

``register(spark, ledger)`` makes the views ``profiles``, ``box_templates``,
``user_boxes``, ``transactions``, ``rates`` and ``op_log`` over a bound or
stored ledger, and the functions of ``FUNCTIONS``, whose bodies Spark inlines
into the calling query:

    SELECT box_id, balance FROM balance_week(DATE '2024-01-25') WHERE point = 6
    SELECT * FROM box_history(10, false) JOIN user_boxes ON id = box_id

Views and functions are temporary, of the session.  Both follow the same rules
as the DataFrame operators, which the tests compare them with.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from jarledger.functions.dates import WEEKDAYS
from jarledger.sources.bind import TABLES, Ledger

MONEY = "DECIMAL(18,2)"

#: Opening balance and in-period day sums of every box; a list is as long as the period at most.
PERIOD = """
WITH dated AS (
  SELECT box_id, to_date(date) AS day, to_date(date) <= as_of AS shown, amount FROM transactions
  WHERE to_date(date) >= date_sub(as_of, {back})
), days AS (
  SELECT box_id, day, shown, SUM(amount) AS net FROM dated GROUP BY box_id, day, shown
), held AS (
  SELECT box_id, SUM(net) AS total, collect_list(CASE WHEN shown THEN named_struct('day', day, 'net', net) END) AS entries
  FROM days GROUP BY box_id
), openings AS (
  SELECT id AS box_id, current_amount AS cur, greatest(0, current_amount - coalesce(total, 0)) AS opening, entries,
         date_sub(as_of, {back}) AS first, as_of AS last
  FROM user_boxes LEFT JOIN held ON held.box_id = id
), points AS (
  SELECT box_id, cur, opening, entries, first, last, explode(sequence(first, last)) AS day FROM openings
)
SELECT box_id, CAST(datediff(day, first) AS BIGINT), day, {label},
       CAST(CASE WHEN day = last THEN cur
                 ELSE opening + coalesce(aggregate(filter(entries, e -> e.day <= points.day), CAST(0 AS DECIMAL(22,2)),
                                                   (a, e) -> CAST(a + e.net AS DECIMAL(22,2))), 0) END AS {money})
FROM points
"""
POINTS = f"box_id BIGINT, point BIGINT, day DATE, label STRING, balance {MONEY}"

#: name: (arguments, columns, body)
FUNCTIONS = {
    "balance_week": ("as_of DATE", POINTS, PERIOD.format(
        back=6, money=MONEY, label="element_at(array(%s), dayofweek(day))" % ", ".join(f"'{w}'" for w in WEEKDAYS))),
    "balance_month": ("as_of DATE", POINTS, PERIOD.format(back=29, money=MONEY, label="CAST(day(day) AS STRING)")),
    "net_saved_month": ("as_of DATE", f"user_id BIGINT, net_saved {MONEY}", f"""
SELECT user_id, CAST(coalesce(SUM(net), 0) AS {MONEY}) FROM user_boxes
LEFT JOIN (SELECT box_id, SUM(amount) AS net FROM transactions WHERE to_date(date) >= trunc(as_of, 'MM') GROUP BY box_id) ON box_id = id
GROUP BY user_id"""),
    "box_history": ("newest INT, archived BOOLEAN", "id BIGINT, box_id BIGINT, amount DECIMAL(12,2), note STRING, date TIMESTAMP_NTZ, rank BIGINT", """
SELECT id, box_id, amount, note, date, CAST(rank AS BIGINT) FROM (
  SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY date DESC, id DESC) AS rank FROM transactions)
JOIN (SELECT id AS owned, coalesce(is_archived, false) AS is_kept FROM user_boxes) ON owned = box_id
WHERE rank <= newest AND is_kept = archived"""),
    "ledger_reconcile": ("", f"box_id BIGINT, stored {MONEY}, tx_sum {MONEY}, drift {MONEY}, opening {MONEY}", f"""
SELECT coalesce(id, box_id), CAST(current_amount AS {MONEY}), CAST(coalesce(net, 0) AS {MONEY}), CAST(current_amount - coalesce(net, 0) AS {MONEY}),
       CAST(greatest(0, current_amount - coalesce(net, 0)) AS {MONEY})
FROM user_boxes FULL JOIN (SELECT box_id, SUM(amount) AS net FROM transactions GROUP BY box_id) ON box_id = id"""),
    "boxes_of": ("owner BIGINT", f"box_id BIGINT, name STRING, currency STRING, balance {MONEY}, target {MONEY}, is_archived BOOLEAN", f"""
SELECT b.id, b.name, upper(coalesce(nullif(b.currency, ''), 'EUR')), CAST(b.current_amount AS {MONEY}),
       CAST(coalesce(b.target_amount, t.total_amount, 0) AS {MONEY}), coalesce(b.is_archived, false)
FROM user_boxes b LEFT JOIN box_templates t ON t.id = b.template_id WHERE b.user_id = owner"""),
}


def register(spark: SparkSession, ledger: Ledger) -> None:
    """Make the views and functions; again for another ledger, they are replaced."""
    for name in TABLES:
        getattr(ledger, name).createOrReplaceTempView(name)
    for name, (arguments, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
