"""Seats of conversations, and who sent and who got each delivered message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.analytics import bracketed

#: Seconds of a slot of a seat's time.
SLOT = 6 * 3600


def seats(conversations: DataFrame, turns: DataFrame, early: int = 5) -> DataFrame:
    """conv, seat and evidence: the seat that a conversation's metadata gives, else the one its earliest turns name first."""
    named = turns.where((F.col("turn_no") <= early) & F.col("preamble_seat").isNotNull()).groupBy("conv").agg(F.min_by("preamble_seat", F.struct("turn_no", "preamble_seat")).alias("named"))
    evidence = F.when(F.col("seat").isNotNull(), "metadata").when(F.col("named").isNotNull(), "preamble")
    return conversations.join(named, "conv", "left").select("conv", F.coalesce("seat", "named").alias("seat"), evidence.alias("evidence"))


def matched_sends(messages: DataFrame, sends: DataFrame, within: int) -> DataFrame:
    """msg_id, target and send_conv of the latest call that sent each message: of its key, from another conversation, at
    most ``within`` seconds before. With several targets only calls to the receiver's own seat count.

    Of each target that its key is sent to about then, a message meets only the latest call of another conversation. It is carried
    forward through the slot's calls as the last call and the last of another conversation than that, so a text
    sent over and over makes no pairs. Of calls of one second the one with the larger conversation and target wins.
    """
    none, slot = F.lit(None), F.floor(F.col("t") / within)
    kind = "struct<at:bigint,send_conv:bigint>"
    s = sends.where("key IS NOT NULL AND send_conv IS NOT NULL").select("key", F.col("at").alias("t"), "target", F.struct(F.col("at").cast("long").alias("at"), F.col("send_conv").cast("long").alias("send_conv")).alias("one"))
    s = s.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    before = F.lag("one").over(Window.partitionBy("key", "slot", "target").orderBy("t", "one.send_conv"))
    calls = s.select("key", "slot", "target", "t", "one", F.when(before["send_conv"] != F.col("one.send_conv"), before).alias("other"), *[none.cast("long").alias(c) for c in ("msg_id", "to_conv")], none.cast("string").alias("conv_seat"))
    m = messages.where("key IS NOT NULL AND to_conv IS NOT NULL").select("msg_id", "key", F.col("sent_at").alias("t"), "to_conv", "conv_seat").withColumn("slot", slot)
    asked = m.join(s.select("key", "slot", "target").distinct(), ["key", "slot"]).withColumns({"one": none.cast(kind), "other": none.cast(kind)})
    order = Window.partitionBy("key", "slot", "target").orderBy("t", F.col("msg_id").asc_nulls_first(), "one.send_conv").rowsBetween(Window.unboundedPreceding, 0)
    carried = calls.unionByName(asked).withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("one", "other")}).where("msg_id IS NOT NULL")
    met = carried.withColumn("met", F.when(F.col("one.send_conv") != F.col("to_conv"), F.col("one")).otherwise(F.col("other"))).where(F.col("met.at") >= F.col("t") - within)
    call = F.struct("met.at", "met.send_conv", "target")
    found = met.groupBy("msg_id").agg(
        (F.min("target") != F.max("target")).alias("several"), F.max(call).alias("latest"), F.max(F.when(F.col("target") == F.col("conv_seat"), call)).alias("own")
    )
    best = F.when(F.col("several"), F.col("own")).otherwise(F.col("latest"))
    return found.select("msg_id", best["target"].alias("target"), best["send_conv"].alias("send_conv")).where("target IS NOT NULL")


def latest_sends(messages: DataFrame, sends: DataFrame, within: int) -> DataFrame:
    """msg_id, send_conv and send_seat of the last call to the resolved seat at most ``within`` seconds before: one order per seat and slot of time, no pairs.

    A call stands in its own slot of ``within`` seconds and in the next, so that a message finds it in its own; seats are few, slots many.
    """
    none, slot = F.lit(None), F.floor(F.col("t") / within)
    call = F.struct(F.col("at").alias("at"), F.col("send_conv").alias("send_conv"), F.col("send_seat").alias("send_seat"))
    kind = "struct<at:bigint,send_conv:bigint,send_seat:string>"
    m = messages.where("to_seat IS NOT NULL").select(F.col("to_seat").alias("seat"), F.col("sent_at").alias("t"), "msg_id", none.cast(kind).alias("call")).withColumn("slot", slot)
    s = sends.select(F.col("target").alias("seat"), F.col("at").alias("t"), none.cast("long").alias("msg_id"), call.cast(kind).alias("call")).withColumn("slot", F.explode(F.array(slot, slot + 1)))
    order = Window.partitionBy("seat", "slot").orderBy("t", F.col("msg_id").asc_nulls_first(), "call.send_conv", "call.send_seat").rowsBetween(Window.unboundedPreceding, 0)
    carried = m.unionByName(s).withColumn("call", F.last("call", ignorenulls=True).over(order)).where("msg_id IS NOT NULL")
    return carried.where(F.col("t") - F.col("call.at") <= within).select("msg_id", "call.send_conv", "call.send_seat")


def only_live(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """msg_id and live_conv: the one conversation of the sender's seat that was live when a message came, the receiver aside.

    How many are live and the sum of their numbers are carried along each seat's time, slot by slot with what the slots
    before add up to, and the receiver's own span is taken off by an equality join; so a seat of many conversations makes no pairs.
    """
    held = spans.where("seat IS NOT NULL AND started IS NOT NULL AND last IS NOT NULL")
    n, slot = F.col("conv").cast("decimal(38,0)"), F.floor(F.col("t") / SLOT)
    event = lambda at, side, sign: held.select("seat", F.col(at).alias("t"), F.lit(side).alias("side"), F.lit(sign).alias("n"), (n * sign).cast("decimal(38,0)").alias("s"), F.lit(None).cast("long").alias("msg_id"))
    asked = messages.where("from_seat IS NOT NULL").select(F.col("from_seat").alias("seat"), F.col("sent_at").alias("t"), F.lit(1).alias("side"), F.lit(0).alias("n"), F.lit(0).cast("decimal(38,0)").alias("s"), "msg_id")
    ends = event("started", 0, 1).unionByName(event("last", 2, -1)).withColumn("slot", slot)
    # one row a seat and slot, of any number of events
    before = Window.partitionBy("seat").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = ends.select("seat", "slot", "n", "s").unionByName(asked.select("seat", slot.alias("slot"), "n", "s")).groupBy("seat", "slot").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    zero = F.lit(0).cast("decimal(38,0)")
    start = sums.select("seat", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before).cast("decimal(38,0)"), zero).alias("s0"))
    order = Window.partitionBy("seat", "slot").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    counted = ends.unionByName(asked.withColumn("slot", slot)).withColumns({"n": F.sum("n").over(order), "s": F.sum("s").over(order).cast("decimal(38,0)")}).where("msg_id IS NOT NULL")
    counted = counted.join(start, ["seat", "slot"]).select("msg_id", (F.col("n") + F.col("n0")).alias("n"), (F.col("s") + F.col("s0")).cast("decimal(38,0)").alias("s"))
    own = held.select(F.col("conv").alias("to_conv"), F.col("seat").alias("from_seat"), "started", "last")
    mine = messages.join(own, ["to_conv", "from_seat"]).where(F.col("sent_at").between(F.col("started"), F.col("last"))).select("msg_id", F.col("to_conv").alias("me"))
    rest = counted.join(mine, "msg_id", "left").select("msg_id", (F.col("n") - F.col("me").isNotNull().cast("int")).alias("n"), (F.col("s") - F.coalesce("me", F.lit(0))).cast("long").alias("live_conv"))
    return rest.where("n = 1").select("msg_id", "live_conv")


def resolve(messages: DataFrame, sends: DataFrame, spans: DataFrame, within: int) -> DataFrame:
    """Each message (msg_id, to_conv, sent_at, from_seat, key) with to_seat, from_conv and the evidence for both.

    to_seat: the call that sent it ("send"), else what the messages around it in the conversation agree on
    ("bracket"), else the conversation's seat ("seat"). from_conv: that call's conversation, else the last call to
    the seat ("call"), unless it is the receiver or contradicts the envelope, else the only live conversation
    of the sender's seat ("live"). ``sends``: send_conv, at, target, key; ``spans``: conv (long, once each), seat, started, last.
    """
    seat_of = spans.select(F.col("conv").alias("to_conv"), F.col("seat").alias("conv_seat"))
    m = messages.join(seat_of, "to_conv", "left")
    m = m.join(matched_sends(m, sends, within), "msg_id", "left")
    m = bracketed(m, "to_conv", ["sent_at", "msg_id"], "target")
    m = m.withColumns(
        {
            "to_seat": F.coalesce("target", "filled", "conv_seat"),
            "seat_by": F.when(F.col("target").isNotNull(), "send").when(F.col("filled").isNotNull(), "bracket").when(F.col("conv_seat").isNotNull(), "seat"),
        }
    ).select("msg_id", "to_conv", "sent_at", "from_seat", "to_seat", "seat_by", F.col("send_conv").alias("matched"))
    calls = sends.join(spans.select(F.col("conv").alias("send_conv"), F.col("seat").alias("send_seat")), "send_conv", "left")
    m = m.join(latest_sends(m, calls, within), "msg_id", "left").join(only_live(m, spans), "msg_id", "left")
    agrees = F.coalesce(F.col("from_seat") == F.col("send_seat"), F.lit(True))
    called = F.when((F.col("send_conv") != F.col("to_conv")) & agrees, F.col("send_conv"))
    evidence = F.when(F.col("matched").isNotNull(), "send").when(called.isNotNull(), "call").when(F.col("live_conv").isNotNull(), "live")
    return m.select("msg_id", "to_conv", "sent_at", "from_seat", "to_seat", "seat_by", F.coalesce("matched", called, "live_conv").alias("from_conv"), evidence.alias("from_by"))


def flows(resolved: DataFrame) -> DataFrame:
    """Messages a day from seat to seat and conversation."""
    day = F.date_format(F.timestamp_seconds("sent_at"), "yyyy-MM-dd").alias("day")
    return resolved.groupBy("from_seat", "to_seat", "to_conv", day).agg(F.count("*").alias("n"))
