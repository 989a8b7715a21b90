"""The analytics tables: counters, activity, tags, messages, similarity and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables, with_views
from corvane.operators import analytics, graphs, vector
from corvane.queries import query
from corvane.queries.search import KNN_SQL, knn
from corvane.scratch import kept


@query(
    with_views(
        """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (turn_class = 'work') AS n_work, count(*) FILTER (turn_class = 'retrieval_result') AS n_retrieval,
        count(*) FILTER (source = 'human') AS n_human, count(*) FILTER (source = 'peer') AS n_peer, count(*) FILTER (role = 'agent') AS n_agent FROM turns GROUP BY conv_id""",
        "turns",
    )
)
def conversation_counters(t: Tables) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return t.turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), is_("turn_class", "work").alias("n_work"), is_("turn_class", "retrieval_result").alias("n_retrieval"),
        is_("source", "human").alias("n_human"), is_("source", "peer").alias("n_peer"), is_("role", "agent").alias("n_agent"),
    )


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS turns, count(*) FILTER (event_type = 'click') AS work, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def activity_daily(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("turns"), F.count_if(F.col("event_type") == "click").alias("work"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


_TAGGED = "tagged AS (SELECT conv_id, unnest(regexp_extract_all(lower(body), '[a-z]{3,}')) AS tag FROM turns WHERE turn_class = 'work')"


def _tagged(t: Tables) -> DataFrame:
    work = t.turns.where("turn_class = 'work'")
    return work.select("conv_id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit("[a-z]{3,}"), F.lit(0))).alias("tag"))


@query(with_views(_TAGGED + " SELECT tag, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM tagged GROUP BY tag", "turns"))
def tag_counts(t: Tables) -> DataFrame:
    return _tagged(t).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


#: Tags that a conversation carries: its most frequent words.
CARRIED = 8
_OFTEN = _TAGGED + f""", tf AS (SELECT conv_id, tag, count(*) AS n FROM tagged GROUP BY 1, 2),
    often AS (SELECT conv_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, tag) AS rank FROM tf) WHERE rank <= {CARRIED})"""


def _carried(t: Tables) -> DataFrame:
    counted = _tagged(t).groupBy("conv_id", "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "tag"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= CARRIED).select("conv_id", "tag")


_PAIRS = _OFTEN + ", pairs AS (SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM often x JOIN often y ON x.conv_id = y.conv_id AND x.tag < y.tag GROUP BY 1, 2)"


@query(with_views(_PAIRS + " SELECT * FROM pairs", "turns"))
def tag_cooc(t: Tables) -> DataFrame:
    return analytics.tag_pairs(_carried(t), "conv_id")


@query(with_views(_PAIRS + ", c AS (SELECT tag, count(*) AS n FROM often GROUP BY tag) SELECT a, b, pairs.n, round(pairs.n / (x.n + y.n - pairs.n), 6) AS jaccard FROM pairs JOIN c x ON a = x.tag JOIN c y ON b = y.tag", "turns"))
def tag_jaccard(t: Tables) -> DataFrame:
    often = _carried(t)
    return analytics.jaccard(analytics.tag_pairs(often, "conv_id"), often.groupBy("tag").agg(F.count("*").alias("n")))


_COUNTED = _TAGGED + ", c AS (SELECT conv_id, tag, count(*) AS tf FROM tagged GROUP BY 1, 2)"


@query(with_views(_COUNTED + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tf DESC, tag) AS rank FROM c) SELECT conv_id, string_agg(tag, ',' ORDER BY rank) AS tags FROM r WHERE rank <= 5 GROUP BY conv_id", "turns"))
def top_tags(t: Tables) -> DataFrame:
    return analytics.top_tags(_tagged(t), "conv_id", 5)


@query(
    with_views(
        _COUNTED
        + """, d AS (SELECT tag, count(*) AS df FROM c GROUP BY tag), w AS (SELECT conv_id, tag, round(tf * ln((1 + (SELECT count(DISTINCT conv_id) FROM tagged)) / (1 + df)), 6) AS weight FROM c JOIN d USING (tag)),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, tag) AS rank FROM w) SELECT * FROM r WHERE rank <= 5""",
        "turns",
    )
)
def distinctive_tags(t: Tables) -> DataFrame:
    return analytics.distinctive(_tagged(t), "conv_id", 5)


@query(
    """SELECT source, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS labelled, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 4) AS toxic, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def coverage(t: Tables) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(share(F.col("quality").isNotNull()).alias("labelled"), share(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("n"))


@query(
    """SELECT coalesce(event_type, 'all') AS facet, count(*) AS n, round(100.0 * count(*) FILTER (event_id % 3 = 0) / nullif(count(*) FILTER (event_id % 3 <> 0), 0), 6) AS autonomy
    FROM events GROUP BY ROLLUP (event_type)"""
)
def facets_autonomy(t: Tables) -> DataFrame:
    of = lambda c: F.count_if(c)
    ratio = F.round(100.0 * of(F.col("event_id") % 3 == 0) / F.nullif(of(F.col("event_id") % 3 != 0), F.lit(0)), 6)
    return t.events.rollup("event_type").agg(F.count("*").alias("n"), ratio.alias("autonomy")).select(F.coalesce("event_type", F.lit("all")).alias("facet"), "n", "autonomy")


@query(
    """WITH r AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1)
    SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN rank <= 3 THEN event_type ELSE 'other' END AS facet, count(*) AS n FROM events JOIN r USING (event_type) GROUP BY 1, 2"""
)
def daily_matrix(t: Tables) -> DataFrame:
    totals = t.events.groupBy("event_type").agg(F.count("*").alias("total"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "event_type")))  # one row an event type
    facet = F.when(F.col("rank") <= 3, F.col("event_type")).otherwise("other")
    return t.events.join(ranked, "event_type").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), facet.alias("facet")).agg(F.count("*").alias("n"))


_DAYS = """d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day), x AS (SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (day))"""


def _days(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(analytics.daily_spine(F.col("a"), F.col("b")).alias("day"))
    return spine.join(days, "day", "left").fillna(0, ["n"])  # one row a day


@query(f"WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM x")
def moving_average(t: Tables) -> DataFrame:
    return _days(t).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.avg("n").over(Window.orderBy("day").rowsBetween(-3, 3)), 6).alias("smooth"))


@query(f"WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM x")
def cumulative(t: Tables) -> DataFrame:
    return _days(t).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


_AT = "e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events)"


def _at(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("secs"))


@query(
    f"""WITH {_AT} SELECT l.user_id, l.secs, l.event_id AS id,
        coalesce((SELECT r.event_id FROM e r WHERE r.event_type = 'view' AND r.user_id = l.user_id AND r.secs <= l.secs AND r.secs >= l.secs - 86400 ORDER BY r.secs DESC, r.event_id DESC LIMIT 1), -1) AS tag
        FROM e l WHERE l.event_type = 'purchase'"""
)
def messages_asof(t: Tables) -> DataFrame:
    e = _at(t)
    left = e.where("event_type = 'purchase'").select("user_id", "secs", F.col("event_id").alias("id"))
    right = e.where("event_type = 'view'").select("user_id", "secs", F.col("event_id").alias("tag"))
    return analytics.asof_backward(left, right, "user_id", "secs", 86400).fillna(-1, ["tag"])


_SPANS = "spans AS (SELECT user_id, event_id AS span_id, secs AS start, secs + 200000 AS stop FROM e WHERE event_type = 'signup')"


@query(f"WITH {_AT}, {_SPANS} SELECT event_id AS id, min(span_id) AS span_id FROM e JOIN spans USING (user_id) WHERE event_type = 'click' AND secs BETWEEN start AND stop GROUP BY event_id HAVING count(*) = 1")
def messages_interval(t: Tables) -> DataFrame:
    e = _at(t)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("secs").alias("start"), (F.col("secs") + 200000).alias("stop"))
    return analytics.within_interval(e.where("event_type = 'click'").select("user_id", "secs", F.col("event_id").alias("id")), spans, "user_id", "secs")


@query(
    f"""WITH {_AT}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_type END AS seen FROM e),
    f AS (SELECT event_id, seen, last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY secs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
    first_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY secs, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM v)
    SELECT event_id, seen, CASE WHEN a = b THEN b END AS filled FROM f"""
)
def bracket_fill(t: Tables) -> DataFrame:
    rows = _at(t).withColumn("seen", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return analytics.bracketed(rows, "user_id", ["secs", "event_id"], "seen").select("event_id", "seen", "filled")


_EDGES = f"{KNN_SQL}, edges AS (SELECT a, b, score AS w FROM knn)"


def _edges(t: Tables) -> DataFrame:
    return kept(knn(t).withColumnRenamed("score", "w"))


@query(
    f"""WITH {_EDGES}, s AS (SELECT w, x.label AS ca, y.label AS cb FROM edges JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id),
    i AS (SELECT ca AS c, sum(w) AS inside FROM s WHERE ca = cb GROUP BY 1), d AS (SELECT c, sum(w) AS degree FROM (SELECT ca AS c, w FROM s UNION ALL SELECT cb, w FROM s) GROUP BY c)
    SELECT round(sum(coalesce(inside, 0) / m - pow(degree / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c), (SELECT sum(w) AS m FROM edges)"""
)
def modularity(t: Tables) -> DataFrame:
    return analytics.modularity(_edges(t), t.embeddings.select(F.col("vec_id").alias("node"), F.col("label").alias("community")))


@query()
def communities(t: Tables) -> DataFrame:
    return analytics.propagate_labels(_edges(t).where("w > 0.2"), kept)


# The labels are the earlier partition, less every seventh row, which counts as new.
def _previous(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("community"))


@query()
def continued_communities(t: Tables) -> DataFrame:
    return graphs.continued(_edges(t).where("w > 0.2"), _previous(t), kept)


@query()
def session_layout(t: Tables) -> DataFrame:
    return graphs.layout(t.embeddings, "label", 64)


@query(
    """WITH m AS (SELECT label, list(mean ORDER BY pos) AS c FROM (SELECT label, i AS pos, avg(CAST(embedding[i + 1] AS DOUBLE)) AS mean FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) r(i) GROUP BY label, i) GROUP BY label)
    SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS centrality FROM embeddings JOIN m USING (label)"""
)
def centrality(t: Tables) -> DataFrame:
    means = vector.centroids(t.embeddings, "label").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("c"))
    return t.embeddings.join(means, "label").select("vec_id", "label", F.round(vector.cosine(F.col("embedding"), F.col("c")), 6).alias("centrality"))


def _novelty_sql(span: int) -> str:
    return f"""WITH f AS (SELECT label, vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) r(i)),
    m AS (SELECT label, vec_id, avg(x) OVER b AS p, avg(x) OVER a AS q, count(x) OVER b AS np, count(x) OVER a AS nq FROM f
        WINDOW b AS (PARTITION BY label, pos ORDER BY vec_id ROWS BETWEEN {span} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY label, pos ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND {span - 1} FOLLOWING))
    SELECT label, vec_id, CASE WHEN min(np) = {span} AND min(nq) = {span} THEN round(1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 6) ELSE 0.0 END AS novelty FROM m GROUP BY label, vec_id"""


@query(_novelty_sql(5))
def novelty(t: Tables) -> DataFrame:
    return analytics.novelty(t.embeddings, "label", "vec_id", 5)


@query()
def topic_shifts(t: Tables) -> DataFrame:
    return analytics.shifts(analytics.novelty(t.embeddings, "label", "vec_id", 5), "label", "vec_id", 5, 12)


@query("SELECT round(sum(pow(share, 2)), 6) AS baseline, max(share) AS largest FROM (SELECT round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source)")
def confound_baseline(t: Tables) -> DataFrame:
    docs = t.documents
    shares = docs.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("total")))).select(F.round(F.col("n") / F.col("total"), 6).alias("share"))
    return shares.agg(F.round(F.sum(F.pow("share", F.lit(2))), 6).alias("baseline"), F.max("share").alias("largest"))


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'role', role, count(*) FROM conversations GROUP BY 2 UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY 2")
def overview_tallies(t: Tables) -> DataFrame:
    tally = lambda df, facet, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
    return tally(t.documents, "lang", "lang").unionAll(tally(t.conversations, "role", "role")).unionAll(tally(t.events, "event", "event_type"))
