"""Messages: the only live conversation against brute force, and each rule of resolution by hand."""

import random

from corvane.operators import messages

SPANS = "conv long, seat string, started long, last long"
MESSAGES = "msg_id long, to_conv long, sent_at long, from_seat string, key string"


def test_only_live_is_brute_force(spark):
    r = random.Random(7)
    spans = [(c, r.choice(["a", "b", None]), s := r.randrange(40), s + r.randrange(12)) for c in range(12)]
    asked = [(m, r.randrange(12), r.randrange(50), r.choice(["a", "b", "c", None]), None) for m in range(300)]
    want = []
    for m, to, at, seat, _ in asked:
        live = [c for c, s, a, b in spans if s is not None and s == seat and a <= at <= b and c != to]
        want += [(m, live[0])] if len(live) == 1 else []
    got = messages.only_live(spark.createDataFrame(asked, MESSAGES), spark.createDataFrame(spans, SPANS))
    assert sorted((x.msg_id, x.live_conv) for x in got.collect()) == want
    assert len(want) > 30


def test_rules(spark):
    spans = spark.createDataFrame([(1, "own", 0, 90), (2, "x", 0, 90), (3, None, 0, 90), (4, "y", 50, 60)], SPANS)
    sends = spark.createDataFrame(
        [(2, 10, "t1", "one"), (2, 30, "t1", "two"), (3, 40, "own", "many"), (3, 40, "t2", "many"), (1, 70, "t9", "mine"), (3, 20, "own", None)],
        "send_conv long, at long, target string, key string",
    )
    rows = [
        (1, 1, 12, None, "one"),  # the call that sent it
        (2, 1, 20, None, None),  # between two that agree; no call to t1 but the one of message 1
        (3, 1, 31, None, "two"),
        (4, 1, 45, None, "many"),  # two targets, one of them the receiver's seat
        (5, 1, 72, None, "mine"),  # sent by the receiver: no match, its own seat
        (6, 3, 55, "y", "late"),  # no seat; the only live conversation of y
        (7, 2, 44, None, "many"),  # two targets, neither the receiver's seat
    ]
    got = messages.resolve(spark.createDataFrame(rows, MESSAGES), sends, spans, 15).collect()
    assert {(r.msg_id, r.to_seat, r.seat_by, r.from_conv, r.from_by) for r in got} == {
        (1, "t1", "send", 2, "send"),
        (2, "t1", "bracket", 2, "call"),
        (3, "t1", "send", 2, "send"),
        (4, "own", "send", 3, "send"),
        (5, "own", "seat", None, None),
        (6, None, None, 4, "live"),
        (7, "x", "seat", None, None),
    }
    none = spark.createDataFrame([], MESSAGES)
    assert messages.resolve(none, sends, spans, 15).count() == 0


def test_seats(spark):
    got = messages.seats(
        spark.createDataFrame([(1, "m"), (2, None), (3, None)], "conv long, seat string"),
        spark.createDataFrame([(1, 1, "p"), (2, 4, "q"), (2, 2, "r"), (3, 6, "late"), (3, 1, None)], "conv long, turn_no long, preamble_seat string"),
    )
    assert {tuple(r) for r in got.collect()} == {(1, "m", "metadata"), (2, "r", "preamble"), (3, None, None)}


def test_matched_sends_are_brute_force_without_pairs(spark):
    """Calls of one key at one time, as the copies of a table have them: the latest of another conversation, with few rows in between."""
    r = random.Random(3)
    sends = [(r.randrange(6), r.randrange(60), r.choice("abc"[: 1 + k % 3]), f"k{k}") for k in range(6) for _ in range(40)]
    asked = [(m, r.randrange(6), r.randrange(70), r.choice(["a", "b", None]), f"k{r.randrange(7)}") for m in range(400)]
    want = []
    for m, to, at, seat, key in asked:
        met = [(t, c, x) for c, t, x, k in sends if k == key and at - 9 <= t <= at and c != to]
        met = [p for p in met if p[2] == seat] if len({p[2] for p in met}) > 1 else met
        want += [(m, max(met)[2], max(met)[1])] if met else []
    given = spark.createDataFrame(asked, "msg_id long, to_conv long, sent_at long, conv_seat string, key string")
    got = messages.matched_sends(given, spark.createDataFrame(sends, "send_conv long, at long, target string, key string"), 9)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 150
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "sent_at" not in plan.split("Join Inner")[0]  # a message is joined with targets, not with times of calls


def test_windows_of_seats_are_cut_by_time(spark):
    given = spark.createDataFrame([(1, 1, 10, "a", "a")], "msg_id long, to_conv long, sent_at long, from_seat string, to_seat string")
    calls = spark.createDataFrame([(2, 9, "a", "s")], "send_conv long, at long, target string, send_seat string")
    plans = [messages.latest_sends(given, calls, 15), messages.only_live(given, spark.createDataFrame([(2, "a", 0, 90)], SPANS))]
    assert [df.count() for df in plans] == [1, 1]
    for df in plans:
        assert any("slot" in line for line in df._jdf.queryExecution().analyzed().toString().splitlines() if line.lstrip(" +-:").startswith("Window"))
