"""URL rules and exact set membership by a cascade of Bloom filters, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.storage import stored

#: Bits for each key of a level and hash functions of each filter.
BITS_PER_KEY, HASHES = 10, 5
#: Bits of one stretch of a filter, as the built-in bitmap aggregate makes it.
STRETCH = 32_768
#: Filters travel inside the plan: a cascade is built for so many keys that its filters stay below this, about,
#: and a plan holds so many cascades.
FILTER_BYTES, PLAN_CASCADES = 4_000_000, 8
#: One in so many keys of the universe passes a filter of five hash functions and ten bits a key wrongly, at most.
WRONGLY = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path): empty for a null URL or one without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def host_suffixes(host: str | Column) -> Column:
    """The host and all its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as bytes, and their number."""

    bits: bytes
    size: int


def _positions(key: Column, level: int, size: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(size)) for j in range(HASHES)])


def bloom_level(keys: DataFrame, level: int, count: int) -> Level:
    """The filter of ``count`` rows of ``keys`` (key): bitmaps are built and merged by aggregation."""
    size = -(-max(64, count * BITS_PER_KEY) // 8) * 8
    at = keys.select(F.explode(_positions(F.col("key"), level, size)).alias("at"))
    rows = at.groupBy(F.expr(f"at div {STRETCH}").alias("stretch")).agg(F.expr(f"bitmap_construct_agg(at % {STRETCH})").alias("bits")).collect()
    bits = bytearray(-(-size // STRETCH) * STRETCH // 8)
    for r in rows:
        bits[r["stretch"] * STRETCH // 8 : (r["stretch"] + 1) * STRETCH // 8] = r["bits"]
    return Level(bytes(bits[: size // 8]), size)


def _contains(key: Column, level: int, bloom: Level) -> Column:
    def bit(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(bloom.bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (F.call_function("getbit", byte, (at % 8).cast("int"))) == 1

    return F.forall(_positions(key, level, bloom.size), bit)


def maybe_listed(keys: DataFrame, column: str) -> Column:
    """Whether ``column`` may be one of the distinct ``keys`` (key): true for each of them, and for few other values.

    A filter of ``FILTER_BYTES`` at most is made, so of very many keys more values pass; an exact join follows where it matters.
    """
    count = min(keys.count(), FILTER_BYTES * 8 // BITS_PER_KEY)
    return _contains(F.col(column), 0, bloom_level(keys, 0, count))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Filters that tell the keys of ``listed`` from all other keys of ``universe`` (both: key), exactly.

    The first encodes the listed keys, the next the other keys that pass the first, the next the listed
    keys that pass the second, and so on until none pass wrongly. Nulls are no keys.
    """
    inside = stored(listed.select("key").filter("key is not null").distinct(), "listed")
    outside = stored(universe.select("key").filter("key is not null").distinct().join(inside, "key", "left_anti"), "unlisted")
    levels: list[Level] = []
    while count := inside.count():
        levels.append(bloom_level(inside, len(levels), count))
        passing = outside.filter(_contains(F.col("key"), len(levels) - 1, levels[-1]))
        inside, outside = stored(passing, "passing"), inside
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """True if ``key``, one of the universe, is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(_contains(key, k, levels[k]), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def _share(key: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(shares))


def build_cascades(listed: DataFrame, universe: DataFrame) -> list[list[Level]]:
    """Cascades over shares of the keys, drawn by a hash, as many as keep each one's filters small."""
    listed, universe = (stored(df.select("key").filter("key is not null").distinct(), name) for df, name in ((listed, "listed"), (universe, "universe")))
    shares = int((listed.count() + universe.count() // WRONGLY) * BITS_PER_KEY // 8 // FILTER_BYTES) + 1
    return [build_cascade(*(df.filter(_share(F.col("key"), shares) == k) for df in (listed, universe))) for k in range(shares)]


def with_membership(rows: DataFrame, keys: Column, cascades: list[list[Level]], name: str) -> DataFrame:
    """``rows`` with a boolean: whether one of the array ``keys``, all of the universe, is listed.

    Long lists have many cascades; a plan tests some of them, and the rows that pass none yet are held
    against the next ones after a table has been stored between.
    """
    shares, rows = len(cascades), rows.withColumn(name, F.lit(False))

    def listed_in(k: int) -> Callable[[Column], Column]:
        return lambda key: in_cascade(key, cascades[k]) if shares == 1 else (_share(key, shares) == k) & in_cascade(key, cascades[k])

    for start in range(0, shares, PLAN_CASCADES):
        if start:
            rows = stored(rows, "judged")
        for k in range(start, min(start + PLAN_CASCADES, shares)):
            rows = rows.withColumn(name, F.col(name) | F.exists(keys, listed_in(k)))
    return rows


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    rules: (verdict, host, path); a rule fits its host and the host's subdomains if the path starts with
    its path; the longest host + path wins, the first of equals. Without a rule a page is blocked if its
    address (host and path), its host or a parent domain is one of ``listed`` (key), and allowed if not.
    Null URLs have an empty host and path and are allowed. Null ids and repeated rows pass through with
    equal results; other columns are not read; an empty table gives none, an empty list blocks nothing.
    """
    host, path = url_parts(url_col)
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    address = F.when((F.col("host") != "") & (F.col("path") != ""), F.array(F.concat("host", "path"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(address, host_suffixes("host"))
    domains = rows.select("host").distinct().select(F.explode(host_suffixes("host")).alias("key"))
    cascades = build_cascades(listed, domains.union(rows.select(F.explode(address).alias("key"))))
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), k))
    ranked = [rules[k] for k in order]
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ranked]
    pick = lambda values, end: reduce(lambda rest, k: F.when(fits[k], F.lit(values[k])).otherwise(rest), range(len(ranked) - 1, -1, -1), end)
    rows = with_membership(rows, keys, cascades, "__listed")
    method = F.when(F.col("__listed"), "block").otherwise("allow")
    return rows.select(
        id_col, "host", "path", pick([h + p for _, h, p in ranked], F.lit(None).cast("string")).alias("rule"), pick([v for v, _, _ in ranked], method).alias("verdict")
    )
