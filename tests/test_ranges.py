"""Ordered operators where one entity has nearly all rows, spread over many ranges, against plain walks."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from stratafold.operators import joins as J
from stratafold.operators import ranges
from stratafold.operators import windows as W


@pytest.fixture
def many_ranges(spark):
    # Small results would share one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed, n=700):
    rnd = random.Random(seed)
    entity = lambda: rnd.choice(["hot"] * 18 + ["b", None])
    return rnd, sorted({(entity(), rnd.randrange(5000)) for _ in range(n)}, key=str)


def test_a_hot_entity_has_many_ranges(many_ranges):
    _, rows = rows_of(1)
    df = many_ranges.createDataFrame(rows, "e string, t long")
    assert ranges.in_ranges(df, "e", ["t"]).filter("e = 'hot'").select("__range").distinct().count() >= 7


def test_interpolation_across_ranges(many_ranges):
    rnd, rows = rows_of(2)
    keys = [(e, t, rnd.random(), rnd.random()) for e, t in rows]
    # Stretches of times without keys, wanted times at keys, before and after all, and of an entity without keys.
    keys = [k for k in keys if not 1000 < k[1] < 3500]
    wanted = sorted({(e, rnd.randrange(-50, 5100)) for e in ["hot"] * 300 + ["b"] * 20 + [None] * 10} | {(k[0], k[1]) for k in keys[::7]} | {("none", 5)}, key=str)
    got = J.asof_interpolate(many_ranges.createDataFrame(keys, "e string, t long, v double, u double"), many_ranges.createDataFrame(wanted, "e string, t long"), "e", "t", ["v", "u"]).collect()
    own = {}
    for e, t, v, u in sorted(keys, key=lambda k: k[1]):
        own.setdefault(e, []).append((t, v, u))

    def at(e, t, c):
        line = own.get(e)
        if not line:
            return None
        k = bisect.bisect_right([x[0] for x in line], t)
        low, high = line[k - 1] if k else None, line[k] if k < len(line) else None
        if not low or not high or low[0] == t:
            return (low or high)[c]
        return low[c] + (high[c] - low[c]) * (t - low[0]) / (high[0] - low[0])

    assert len(got) == len(wanted)
    for r in got:
        for c, name in ((1, "v"), (2, "u")):
            want = at(r["e"], r["t"], c)
            assert (r[name] is None) == (want is None) and (want is None or abs(r[name] - want) < 1e-9)


def test_angles_and_carried_values_across_ranges(many_ranges):
    rnd, rows = rows_of(3)
    rows = [(e, t, rnd.uniform(0, 360) if rnd.random() > 0.02 else None, rnd.choice([None] * 30 + ["x", "y"])) for e, t in rows]
    df = many_ranges.createDataFrame(rows, "e string, t long, a double, v string")
    turned = {(r["e"], r["t"]): r["unwrapped"] for r in W.unwrap_angle(df, "e", "t", "a").collect()}
    held = {(r["e"], r["t"]): r["held"] for r in W.carry_down(df, "e", "t", F.col("v"), "held").collect()}
    for e in ("hot", "b", None):
        before, total, last = None, 0.0, None
        for _, t, a, v in sorted((r for r in rows if r[0] == e), key=lambda r: r[1]):
            if a is not None and before is not None:
                total += -360 * round((a - before) / 360)
            assert (turned[e, t] is None) == (a is None) and (a is None or abs(turned[e, t] - (a + total)) < 1e-6)
            before, last = a, v or last
            assert held[e, t] == last
    assert W.carry_down(df.filter("1 = 0"), "e", "t", F.col("v"), "held").count() == 0
