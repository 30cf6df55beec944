"""Exact top-k inner products by best-first search in M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.storage import stored

#: Vectors that divide the space into regions, classes of equal vectors in one tree, entries of a page.
PIVOTS, CELL_CLASSES, PAGE = 64, 4096, 64
#: Queries that one task holds beside one tree.
BLOCK_QUERIES = 1024


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>) with v = floor(1024 * x); rows whose vector is null, empty or not finite are left out."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter("id is not null and size(x) > 0").filter(F.coalesce(good.cast("boolean"), F.lit(False)))
    return rows.select("id", F.transform("x", lambda e: F.floor(e * 1024).cast("long")).alias("v"))


class Space:
    """Inner products as distances: each vector gets a coordinate more, so that all have the norm ``top``.

    The squared distance of a query (with that coordinate zero) is |q|^2 + top^2 - 2 <q, x>.
    """

    def __init__(self, top: float, width: int) -> None:
        self.top, self.width = top, width

    def matrix(self, vectors: pd.Series) -> np.ndarray:
        """Rows padded with zeros to the width."""
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1)))[:, None]], axis=1)

    def far(self, q: np.ndarray, score: np.ndarray | float) -> np.ndarray | float:
        return np.sqrt(np.maximum(0.0, q @ q + self.top - 2 * score))

    def far_all(self, q: np.ndarray, centre: np.ndarray | None, score: np.ndarray | None = None) -> np.ndarray:
        """Of each row of q: the distance to ``centre``, or to where the inner product is ``score``."""
        score = q @ centre if score is None else score
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + self.top - 2 * score))


def build_pages(x: np.ndarray, lifted: np.ndarray) -> list[dict]:
    """Pages of an M-tree over the rows of x. An entry: its object, its distance to the page's own
    routing object, and on inner pages its covering radius and child page; page 0 is the root."""
    pages: list[dict] = []

    def add(rows: np.ndarray, centre: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        away = np.linalg.norm(lifted[rows] - centre, axis=1)
        if len(rows) <= PAGE:
            pages[number] = {"rows": rows, "away": away, "radius": None, "child": None}
            return number
        fan = int(min(PAGE, -(-len(rows) // (PAGE // 2))))
        seeds = [int(away.argmax())]
        near = np.linalg.norm(lifted[rows] - lifted[rows[seeds[0]]], axis=1)
        owner = np.zeros(len(rows), np.int64)
        while len(seeds) < max(2, fan):
            new = int(near.argmax())
            d = np.linalg.norm(lifted[rows] - lifted[rows[new]], axis=1)
            owner[d < near] = len(seeds)
            near = np.minimum(near, d)
            seeds.append(new)
        children, radii = [], []
        for k, s in enumerate(seeds):
            own = rows[owner == k]
            radii.append(float(near[owner == k].max()))
            children.append(add(own, lifted[rows[s]]))
        pages[number] = {"rows": rows[seeds], "away": away[seeds], "radius": np.array(radii), "child": np.array(children)}
        return number

    add(np.arange(len(x)), lifted[0])
    return pages


def search(space: Space, x: np.ndarray, pages: list[dict], root: float, q: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
    """The (score, row) of the k best rows, and of all that tie with the last, with a score of ``floor`` at least.

    ``root``: the distance of q to the routing object of the root. Pages are taken by their least
    possible distance; entries that the stored distances rule out are not computed.
    """
    slack = 1e-6 * (1 + np.sqrt(space.top))
    limit = space.far(q, floor) + slack
    best: list[float] = []
    found: list[tuple[float, int]] = []
    heap = [(0.0, 0, root)]
    while heap:
        low, number, own = heapq.heappop(heap)
        if low > limit:
            break
        page = pages[number]
        reach = limit if page["radius"] is None else limit + page["radius"]
        open_ = np.flatnonzero(np.abs(own - page["away"]) <= reach)
        if not len(open_):
            continue
        rows = page["rows"][open_]
        score = x[rows] @ q
        if page["radius"] is None:
            for s, r in zip(score.tolist(), rows.tolist(), strict=True):
                if s >= floor:
                    found.append((s, r))
                    if len(best) < k:
                        heapq.heappush(best, s)
                    elif s > best[0]:
                        heapq.heapreplace(best, s)
            if len(best) == k and best[0] > floor:
                floor = best[0]
                limit = space.far(q, floor) + slack
        else:
            d = space.far(q, score)
            low = np.maximum(0.0, d - page["radius"][open_])
            for j in np.flatnonzero(low <= limit):
                heapq.heappush(heap, (float(low[j]), int(page["child"][open_[j]]), float(d[j])))
    return [f for f in found if f[0] >= floor]


def _tree_rows(space: Space) -> object:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        x = space.matrix(rows["v"])
        out = []
        for number, p in enumerate(build_pages(x, space.lift(x))):
            at, inner = p["rows"], p["radius"] is not None
            out.append((key[0], number, x[at].tobytes(), p["away"].tobytes(), p["radius"].tobytes() if inner else None,
                        p["child"].astype(np.int64).tobytes() if inner else None, [] if inner else [rows["ids"][i] for i in at], x[:1].tobytes() if not number else None))
        return pd.DataFrame(out, columns=["cell", "page", "objects", "away", "radius", "child", "ids", "centre"])

    return build


PAGES = "cell long, page long, objects binary, away binary, radius binary, child binary, ids array<array<long>>, centre binary"


def _search_rows(space: Space, k: int) -> object:
    def run(queries: pd.DataFrame, stored_pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(stored_pages):
            stored_pages = stored_pages.sort_values("page")
            objects = [np.frombuffer(b).reshape(-1, space.width) for b in stored_pages["objects"]]
            ends = np.cumsum([len(o) for o in objects])
            x, pages, ids = np.concatenate(objects), [], {}
            for start, o, r in zip(ends - [len(o) for o in objects], objects, stored_pages.itertuples(), strict=True):
                at = np.arange(start, start + len(o))
                inner = r.radius is not None
                pages.append({"rows": at, "away": np.frombuffer(r.away), "radius": np.frombuffer(r.radius) if inner else None, "child": np.frombuffer(r.child, np.int64) if inner else None})
                if not inner:
                    ids.update(zip(at.tolist(), r.ids, strict=True))
            centre = np.frombuffer(stored_pages["centre"].iloc[0])
            for q, rep, floor in zip(space.matrix(queries["v"]), queries["id"], queries["floor"], strict=True):
                root = float(space.far(q, centre @ q))
                for score, row in search(space, x, pages, root, q, k, floor):
                    out.extend((rep, int(score), int(i)) for i in ids[row])
        return pd.DataFrame(out, columns=["id", "score", "vec_id"]).astype({"id": "int64", "score": "int64", "vec_id": "int64"})

    return run


def top_inner_products(df: DataFrame, id_col: str, vector_col: str, is_query: object, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product, ties to the smaller id.

    is_query: a Column of ``id``. Equal vectors form one class with its k + 1 smallest ids, which is
    all that any result can hold of it. A bounded set of pivots divides the classes into regions, and
    regions into trees of about ``CELL_CLASSES`` classes. Each query first searches one tree near it;
    the score it finds rules out regions, and the other trees are searched from that score on.

    Vectors that are null, empty or hold null or non-finite components take no part; shorter vectors
    count as padded with zeros; rows repeated with one id count once. Scores are exact while squared
    norms stay below 2 ** 52. No rows, or no queries, give no result.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col)
    # Spark keeps the first k + 1 rows of a vector in each partition before it shuffles them.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.select("v", "id").distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, e: a + e.cast("double") * e.cast("double"))
    classes = stored(classes.select(F.col("ids")[0].alias("id"), "v", "ids", norm.alias("norm"), F.size("v").alias("width")), "classes")
    top, width = classes.agg(F.max("norm"), F.max("width")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if top is None:
        return empty
    space = Space(float(top), int(width))
    pivots = classes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toPandas()["v"]
    centres = space.lift(space.matrix(pivots))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = space.lift(space.matrix(b["v"]))
            d = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T))
            near = d.argmin(axis=1)
            yield b[["id", "v", "ids"]].assign(pivot=near, away=np.linalg.norm(x - centres[near], axis=1))

    placed = stored(classes.mapInPandas(assign, "id long, v array<long>, ids array<long>, pivot long, away double"), "placed")
    regions = {r["pivot"]: (-(-r["n"] // CELL_CLASSES), r["far"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    parts = F.create_map(*[F.lit(int(x)) for p, (n, _) in regions.items() for x in (p, n)])
    scale = 1 << 24
    cell = F.col("pivot") * scale + F.pmod(F.xxhash64("id"), parts[F.col("pivot").cast("int")].cast("long"))
    pages = stored(placed.withColumn("cell", cell).groupBy("cell").applyInPandas(_tree_rows(space), PAGES), "pages")

    asked = rows.filter(is_query).distinct()
    queries = asked.join(placed.select("v", F.col("id").alias("rep")), "v").select(F.col("id").alias("query_id"), "rep")
    queries = stored(queries, "queries")
    sought = stored(placed.join(queries.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "sought")
    blocks = int(sought.count() // BLOCK_QUERIES) + 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")

    def searched(asked: DataFrame) -> DataFrame:
        # A tree travels to those blocks of queries alone that have one for its cell.
        wanted = asked.select("cell", block).distinct()
        left = asked.select("id", "v", "floor", "cell", block).groupBy("cell", "block")
        return left.cogroup(pages.join(wanted, "cell").groupBy("cell", "block")).applyInPandas(_search_rows(space, k + 1), "id long, score long, vec_id long")

    lowest = F.lit(-float(1 << 62))
    first = searched(sought.withColumn("cell", cell).withColumn("floor", lowest))
    in_order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    first = first.withColumn("n", F.row_number().over(in_order)).filter(F.col("n") == k + 1).select("id", F.col("score").cast("double").alias("floor"))
    start = stored(sought.select("id", "v").join(first, "id", "left").select("id", "v", F.coalesce("floor", lowest).alias("floor")), "floors")
    reach = [(p, n, far) for p, (n, far) in sorted(regions.items())]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slack = 1e-6 * (1 + np.sqrt(space.top))
        for b in batches:
            q, out = space.matrix(b["v"]), []
            d = np.stack([space.far_all(q, centres[p, :-1]) for p, _, _ in reach], axis=1)
            limit = space.far_all(q, None, b["floor"].to_numpy()) + slack
            for i in range(len(b)):
                cells = [p * scale + s for (p, n, far), own in zip(reach, d[i], strict=True) if own - far <= limit[i] for s in range(n)]
                out.append((b["id"].iloc[i], b["v"].iloc[i], b["floor"].iloc[i], cells))
            yield pd.DataFrame(out, columns=["id", "v", "floor", "cells"])

    wide = start.mapInPandas(spread, "id long, v array<long>, floor double, cells array<long>")
    found = searched(stored(wide.select("id", "v", "floor", F.explode("cells").alias("cell")), "reach"))
    found = found.withColumn("n", F.row_number().over(in_order)).filter(F.col("n") <= k + 1)
    result = queries.join(found.withColumnRenamed("id", "rep"), "rep").filter("vec_id <> query_id")
    ranked = result.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
