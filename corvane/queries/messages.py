"""Messages between conversations, told from events: a view is a delivery to its user, a click a send by its user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.model import Tables
from corvane.operators import messages
from corvane.queries import query

WITHIN = 6 * 3600
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
_SEATS = f"""c AS (SELECT user_id AS conv, CASE WHEN user_id % 3 = 0 THEN 's' || (user_id % 11) END AS seat, min({_SECONDS}) AS started, max({_SECONDS}) AS last FROM events GROUP BY user_id),
    t AS (SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_no, CASE WHEN event_type = 'purchase' THEN 's' || (event_id % 11) END AS preamble_seat FROM events),
    p AS (SELECT conv, arg_min(preamble_seat, turn_no) AS named FROM t WHERE turn_no <= 5 AND preamble_seat IS NOT NULL GROUP BY conv),
    spans AS (SELECT conv, coalesce(seat, named) AS seat, CASE WHEN seat IS NOT NULL THEN 'metadata' WHEN named IS NOT NULL THEN 'preamble' END AS evidence, started, last FROM c LEFT JOIN p USING (conv))"""
_RESOLVED = f"""WITH {_SEATS},
    m AS (SELECT event_id AS msg_id, user_id AS to_conv, {_SECONDS} AS sent_at, CASE WHEN event_id % 2 = 0 THEN 's' || (event_id % 11) END AS from_seat, props AS key, seat AS conv_seat FROM events JOIN spans ON conv = user_id WHERE event_type = 'view'),
    s AS (SELECT user_id AS send_conv, {_SECONDS} AS sec, 's' || (event_id % 7) AS target, props AS key, seat AS send_seat FROM events JOIN spans ON conv = user_id WHERE event_type = 'click'),
    q AS (SELECT msg_id, conv_seat, sec, target, send_conv, min(target) OVER (PARTITION BY msg_id) <> max(target) OVER (PARTITION BY msg_id) AS several
        FROM m JOIN s ON m.key = s.key AND sent_at - sec BETWEEN 0 AND {WITHIN} AND send_conv <> to_conv),
    d AS (SELECT msg_id, target, send_conv FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY sec DESC, send_conv DESC, target DESC) AS n FROM q WHERE NOT several OR target = conv_seat) WHERE n = 1),
    b AS (SELECT m.*, target, d.send_conv AS matched, last_value(target IGNORE NULLS) OVER (PARTITION BY to_conv ORDER BY sent_at, m.msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev,
        first_value(target IGNORE NULLS) OVER (PARTITION BY to_conv ORDER BY sent_at, m.msg_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM m LEFT JOIN d USING (msg_id)),
    f AS (SELECT *, CASE WHEN target IS NOT NULL THEN target WHEN prev = next THEN prev ELSE conv_seat END AS to_seat,
        CASE WHEN target IS NOT NULL THEN 'send' WHEN prev = next THEN 'bracket' WHEN conv_seat IS NOT NULL THEN 'seat' END AS seat_by FROM b),
    k AS (SELECT * FROM (SELECT msg_id, to_conv, from_seat, s.send_conv, s.send_seat, row_number() OVER (PARTITION BY msg_id ORDER BY sec DESC, s.send_conv DESC, s.send_seat DESC NULLS LAST) AS n
        FROM f JOIN s ON s.target = f.to_seat AND sent_at - sec BETWEEN 0 AND {WITHIN}) WHERE n = 1),
    kk AS (SELECT msg_id, send_conv AS called FROM k WHERE send_conv <> to_conv AND coalesce(from_seat = send_seat, TRUE)),
    l AS (SELECT msg_id, min(conv) AS live_conv FROM m JOIN spans ON seat = from_seat AND sent_at BETWEEN started AND last AND conv <> to_conv GROUP BY msg_id HAVING count(*) = 1),
    r AS (SELECT msg_id, to_conv, sent_at, from_seat, to_seat, seat_by, coalesce(matched, called, live_conv) AS from_conv,
        CASE WHEN matched IS NOT NULL THEN 'send' WHEN called IS NOT NULL THEN 'call' WHEN live_conv IS NOT NULL THEN 'live' END AS from_by FROM f LEFT JOIN kk USING (msg_id) LEFT JOIN l USING (msg_id))"""


def _spans(t: Tables) -> DataFrame:
    seconds = F.unix_timestamp("ts")
    conversations = t.events.groupBy(F.col("user_id").alias("conv")).agg(F.min(seconds).alias("started"), F.max(seconds).alias("last"))
    known = conversations.select("conv", F.when(F.col("conv") % 3 == 0, F.concat(F.lit("s"), F.col("conv") % 11)).alias("seat"))
    turn = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    turns = t.events.select(F.col("user_id").alias("conv"), turn.alias("turn_no"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("s"), F.col("event_id") % 11)).alias("preamble_seat"))
    return messages.seats(known, turns).join(conversations, "conv")


def _resolved(t: Tables) -> DataFrame:
    at = F.unix_timestamp("ts")
    got = t.events.where("event_type = 'view'").select(
        F.col("event_id").alias("msg_id"), F.col("user_id").alias("to_conv"), at.alias("sent_at"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), F.col("event_id") % 11)).alias("from_seat"), F.col("props").alias("key")
    )
    sent = t.events.where("event_type = 'click'").select(F.col("user_id").alias("send_conv"), at.alias("at"), F.concat(F.lit("s"), F.col("event_id") % 7).alias("target"), F.col("props").alias("key"))
    return messages.resolve(got, sent, _spans(t), WITHIN)


@query(f"WITH {_SEATS} SELECT conv, seat, evidence FROM spans")
def conversation_seats(t: Tables) -> DataFrame:
    return _spans(t).select("conv", "seat", "evidence")


@query(f"{_RESOLVED} SELECT * FROM r")
def resolved_messages(t: Tables) -> DataFrame:
    return _resolved(t)


@query(f"{_RESOLVED} SELECT from_seat, to_seat, to_conv, strftime(make_timestamp(sent_at * 1000000), '%Y-%m-%d') AS day, count(*) AS n FROM r GROUP BY 1, 2, 3, 4")
def message_flows(t: Tables) -> DataFrame:
    return messages.flows(_resolved(t))
