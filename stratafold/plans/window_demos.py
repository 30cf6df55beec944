"""Queries of ordered operators over the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import windows as W
from stratafold.plans.registry import demo


@demo("""WITH g AS (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM g WHERE o_totalprice >= 0.5 * top)
SELECT o_custkey, o_orderkey FROM r WHERE r = 1""")
def win1_gated_best(t):
    return W.gated_best(t.orders, "o_custkey", "o_totalprice", ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@demo("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS turn FROM orders")
def win2_round_robin(t):
    return W.round_robin(t.orders, "o_custkey", ["o_orderkey"]).select("o_orderkey", "turn")


@demo("""WITH a AS (SELECT user_id, event_id, (value * 37.0) % 360 AS a FROM events), s AS (SELECT *, coalesce(-360 * round((a - lag(a) OVER (PARTITION BY user_id ORDER BY event_id)) / 360), 0) AS s FROM a)
SELECT event_id, round(a + sum(s) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS unwrapped FROM s""")
def win3_unwrap_angle(t):
    rows = t.events.withColumn("a", (F.col("value") * 37.0) % 360)
    return W.unwrap_angle(rows, "user_id", "event_id", "a").select("event_id", F.round("unwrapped", 6).alias("unwrapped"))


@demo("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)
SELECT o_orderpriority, o_orderkey FROM r WHERE r % greatest(n // 8, 1) = 0 AND r // greatest(n // 8, 1) < 8""")
def win4_even_sample(t):
    return W.even_sample(t.orders, "o_orderpriority", ["o_orderdate", "o_orderkey"], 8).select("o_orderpriority", "o_orderkey")


@demo("""SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000""")
def win5_budget_prefix(t):
    return W.budget_prefix(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", ["doc_id"], 20000).select("source", "doc_id", "used")


@demo("SELECT event_id, CAST(greatest(coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000) - event_id, 0.03) AS DOUBLE) AS hold FROM events")
def win6_hold_time(t):
    return W.hold_time(t.events, "user_id", "event_id", F.lit(1000000)).select("event_id", F.col("hold").cast("double").alias("hold"))


@demo("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def win8_draw_order(t):
    return W.draw_order(t.orders, "o_custkey", ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "place")


@demo("""SELECT user_id, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r = (n + 1) // 2""")
def win9_median_instant(t):
    return W.median_row(t.events, "user_id", "value", "event_id").select("user_id", "event_id")


@demo("""SELECT conv_id, turn, md5(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '')) AS asked FROM conversations""")
def win10_carry_down(t):
    rows = W.carry_down(t.conversations, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "u")
    return rows.select("conv_id", "turn", F.md5(F.coalesce("u", F.lit(""))).alias("asked"))


@demo("SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 300 OFFSET 300")
def win11_paging(t):
    return W.page_of(t.part.select("p_partkey", "p_size"), ["p_size", "p_partkey"], 1, 300).select("p_partkey")


@demo("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def win12_top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
