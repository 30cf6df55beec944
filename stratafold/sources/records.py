"""Records inside text files as tables: tile maps, schemas, region descriptors, materials, hierarchies, curves, meshes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.operators import windows

NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
#: Class numbers of the documents that a hierarchy is read from.
NODE, TRANSFORMS, RENDERERS, LEVELS_OF_DETAIL = 1, (4, 224), (23, 137, 212), 205


def parse_tilemaps(df: DataFrame, id_col: str, text: str, board: str, shelf: str, limits: dict[str, list[str]]) -> DataFrame:
    """One row of counts for each map in JSON that is an object; texts that are none are left out.

    Of the layers of type ``tilelayer``, those whose name matches ``shelf`` are shelves; those that match
    ``board`` are the board, or if none does, those named like the first fullest one; the rest are obstacles.
    Empty cells (0, null) do not count. Layers of other types are groups of objects. Columns:
    width, height, layers, depth_layers (of the board), item_tiles and distinct_items (on the board),
    obstacle_layers (names, in order), obstacle_tiles, shelf_tiles, shelf_types (distinct tiles of the last shelf),
    object_layers (distinct names, in order), object_groups, properties, and a column for each of ``limits``.

    Properties of the layers and then the map's own, an object or a list of names with values, are put
    together; of equal names the last counts. A limit is the first of its keys, in any letter case, that reads as a number, cut to an integer.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def entries(owner: Column) -> Column:
        mapped = F.transform(F.map_entries(get(owner, "$.properties", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        listed = F.transform(get(owner, "$.properties", "array<variant>"), lambda p: F.struct(get(p, "$.name", "string").alias("key"), get(p, "$.value", "string").alias("value")))
        return F.coalesce(mapped, listed, empty("struct<key:string,value:string>"))

    def layer(x: Column) -> Column:
        cells = F.filter(F.coalesce(get(x, "$.data", "array<bigint>"), empty("bigint")), lambda c: c != 0)
        return F.struct(F.coalesce(get(x, "$.name", "string"), F.lit("")).alias("name"), get(x, "$.type", "string").eqNullSafe(F.lit("tilelayer")).alias("tile"), cells.alias("cells"), entries(x).alias("own"))

    # Exploded, so that the filter is not pushed below it, where each text would be made and parsed again.
    rows = df.select(F.col(id_col), F.explode(F.array(F.try_parse_json(text))).alias("m")).filter(get(F.col("m"), "$", "map<string,variant>").isNotNull())
    rows = rows.select(id_col, get("m", "$.width", "int").alias("width"), get("m", "$.height", "int").alias("height"), F.coalesce(get("m", "$.layers", "array<variant>"), empty("variant")).alias("ls"), entries(F.col("m")).alias("own"))
    rows = rows.withColumn("ls", F.transform("ls", layer)).withColumn("tiled", F.filter("ls", lambda x: x["tile"]))
    # The first fullest layer: the largest size, then the smallest place.
    fullest = F.array_max(F.transform("tiled", lambda x, k: F.struct(F.size(x["cells"]).alias("n"), (-k).alias("k"), x["name"].alias("name"))))["name"]
    rows = rows.withColumn("named", F.exists("tiled", lambda x: F.rlike(x["name"], F.lit(board)))).withColumn("fullest", fullest)
    zero, (shelves, boards, others, groups) = F.lit(0), range(4)

    def kinds(x: Column) -> Column:
        on_board = F.when(F.col("named"), F.rlike(x["name"], F.lit(board))).otherwise(x["name"] == F.col("fullest"))
        kind = F.when(~x["tile"], groups).when(F.rlike(x["name"], F.lit(shelf)), shelves).when(on_board, boards).otherwise(others)
        return F.struct(x["name"].alias("name"), x["cells"].alias("cells"), F.size(x["cells"]).alias("n"), kind.alias("kind"), x["own"].alias("own"))

    rows = rows.withColumn("ls", F.transform("ls", kinds))
    start = F.struct(zero.alias("depth_layers"), zero.alias("item_tiles"), empty("bigint").alias("items"), empty("string").alias("obstacle_layers"), zero.alias("obstacle_tiles"), zero.alias("shelf_tiles"), zero.alias("shelf_types"), empty("string").alias("object_layers"), zero.alias("object_groups"))

    def count(s: Column, x: Column) -> Column:
        n, (on_shelf, on_board, other, group) = x["n"], [x["kind"] == k for k in (shelves, boards, others, groups)]
        more = lambda name, when, by: (s[name] + F.when(when, by).otherwise(zero)).alias(name)
        return F.struct(
            more("depth_layers", on_board, F.lit(1)), more("item_tiles", on_board, n), F.when(on_board, F.array_union(s["items"], x["cells"])).otherwise(s["items"]).alias("items"),
            F.when(other, F.array_append(s["obstacle_layers"], x["name"])).otherwise(s["obstacle_layers"]).alias("obstacle_layers"), more("obstacle_tiles", other, n), more("shelf_tiles", on_shelf, n),
            F.when(on_shelf, F.size(F.array_distinct(x["cells"]))).otherwise(s["shelf_types"]).alias("shelf_types"),
            F.when(group & (x["name"] != ""), F.array_union(s["object_layers"], F.array(x["name"]))).otherwise(s["object_layers"]).alias("object_layers"), more("object_groups", group, F.lit(1)),
        )

    rows = rows.withColumn("s", F.aggregate("ls", start, count)).withColumn("all", F.concat(F.flatten(F.transform("ls", lambda x: x["own"])), "own")).withColumn("all", F.filter("all", lambda e: e["key"].isNotNull()))
    numeric = lambda e: F.coalesce(e["value"].try_cast("double"), e["value"].try_cast("boolean").cast("double")).try_cast("int")
    # Letter case and number of an entry are found once, not once for each limit.
    rows = rows.withColumn("numbers", F.transform("all", lambda e: F.struct(F.lower(e["key"]).alias("key"), numeric(e).alias("number"))))
    last = F.filter("all", lambda e, k: ~F.exists(F.slice("all", k + 2, F.size("all")), lambda o: o["key"] == e["key"]))
    keyed = lambda k: F.try_element_at(F.filter("numbers", lambda e: e["key"] == k.lower()), F.lit(-1))["number"]
    limit = lambda keys: F.coalesce(*[keyed(k) for k in keys]) if keys else F.lit(None).cast("int")
    counts = [F.col("s")[c].alias(c) for c in ("depth_layers", "item_tiles", "obstacle_layers", "obstacle_tiles", "shelf_tiles", "shelf_types", "object_layers", "object_groups")]
    return rows.select(
        id_col, "width", "height", F.size("ls").alias("layers"), *counts, F.size(F.col("s")["items"]).alias("distinct_items"), F.map_from_entries(last).alias("properties"), *[limit(keys).alias(name) for name, keys in limits.items()]
    )


def corpus_samples(files: DataFrame, folder: str, path: str, least: int = 12, n: int = 8) -> DataFrame:
    """Of each folder with ``least`` numbered files at least, ``n`` evenly spaced ones, in order of their number, as (folder, path, files).

    The number is the first one in the file's name without its extension. Only names are looked at.
    """
    number = F.regexp_extract(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), r"(\d+)", 1).try_cast("decimal(38,0)")
    rows = files.select(folder, path, number.alias("__k")).filter("__k is not null")
    big = rows.groupBy(folder).agg(F.count("*").alias("files")).filter(F.col("files") >= least)
    return windows.even_sample(rows.join(big, folder), folder, ["__k", path], n).select(folder, path, "files")


def read_samples(spark: SparkSession, samples: DataFrame, path: str) -> DataFrame:
    """(path, text) of the sampled files alone; there are a few for each folder, so their paths go through the driver."""
    paths = [r[0] for r in samples.select(path).distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def fit_schema(samples: DataFrame, candidates: DataFrame, hint: str = "", least: float = 0.9) -> DataFrame:
    """(schema, score, fields, chosen) of each candidate (schema, field, kind) against samples (sample, field, value).

    A sample's score is the share of its populated fields that read as their declared kind, or 0 if one
    is not declared; a schema's score is the mean. The best of ``least`` or more is chosen; ties go to a
    name that holds ``hint``, then to the schema with fewest fields, then by name. Kinds are long, double,
    date, boolean; anything else is text, which any value is.
    """
    filled = samples.filter("sample is not null and value is not null and value <> ''")
    total = filled.groupBy("sample").agg(F.count("*").alias("n"))
    kinds = ("long", "double", "date", "boolean")
    reads = reduce(lambda c, k: c.when(F.col("kind") == k, F.col("value").try_cast(k).isNotNull()), kinds, F.when(F.col("kind").isNull(), True)).otherwise(True)
    held = filled.join(candidates, "field").groupBy("sample", "schema").agg(F.count("*").alias("declared"), F.count_if(reads).alias("good"))
    share = F.when(F.col("declared") == F.col("n"), F.col("good") / F.col("n")).otherwise(0.0)
    sums = held.join(total, "sample").groupBy("schema").agg(F.sum(share).alias("sum"))
    known = total.count()
    sizes = candidates.groupBy("schema").agg(F.count("*").alias("fields"))
    scored = sizes.join(sums, "schema", "left").select("schema", F.coalesce(F.col("sum") / max(known, 1), F.lit(0.0)).alias("score"), "fields")
    order = Window.orderBy(F.desc("score"), ~F.contains(F.lower("schema"), F.lit(hint.lower())), "fields", "schema")  # one row for each schema
    return scored.select("*", ((F.row_number().over(order) == 1) & (F.col("score") >= least)).alias("chosen"))


def parse_region_descriptor(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, page, region, x, y, w, h, rotate) of descriptors given as numbered lines.

    A line without a colon opens a page if an unindented ``size:`` follows at once, else a region of the
    last page. Places are ``xy`` and ``size``, or ``bounds``; rotate is in degrees, ``true`` is 90. Of a
    key that a region repeats the first counts; regions before any page and regions without a place are left out.
    """
    w = Window.partitionBy(file).orderBy(number)
    rows = lines.select(file, number, F.rtrim(line).alias("raw")).filter("raw <> ''").withColumn("next", F.lead("raw").over(w))
    name = ~F.contains("raw", F.lit(":"))
    page = name & F.coalesce(F.startswith("next", F.lit("size:")), F.lit(False))
    rows = rows.withColumn("page", F.last(F.when(page, F.trim("raw")), True).over(w)).withColumn("opens", F.when(name, F.struct(F.col(number).alias("at"), F.trim("raw").alias("region"), page.alias("page"))))
    rows = rows.withColumn("open", F.last("opens", True).over(w)).filter("open is not null and not open.page and page is not null")
    key, value = F.trim(F.substring_index("raw", ":", 1)), F.trim(F.regexp_replace("raw", "^[^:]*:", ""))
    got = lambda k: F.min_by(F.when(key == k, value), F.when(key == k, F.col(number)))
    g = rows.groupBy(file, "page", F.col("open.at").alias("at"), F.col("open.region").alias("region")).agg(*[got(k).alias(k) for k in ("xy", "size", "bounds", "rotate")])
    part = lambda c, k: F.trim(F.get(F.split(c, ","), F.lit(k))).try_cast("int")
    turn = F.when(F.col("rotate") == "true", 90).otherwise(F.coalesce(F.col("rotate").try_cast("int"), F.lit(0)))
    place = [F.coalesce(part("bounds", k), part(*old)).alias(n) for k, (n, old) in enumerate({"x": ("xy", 0), "y": ("xy", 1), "w": ("size", 0), "h": ("size", 1)}.items())]
    return g.select(file, "page", "region", *place, turn.alias("rotate")).filter("x is not null and w is not null")


def parse_materials(df: DataFrame, id_col: str, text: str, albedo: list[str], colours: list[str]) -> DataFrame:
    """(id, slots, r, g, b, a): the bound texture slots as (slot, guid), and the colour that is stated.

    Slots and colours stand one to a line, with or without a list dash; a leading underscore of a name
    is kept, and does not matter to ``albedo`` and ``colours``. Unbound slots (file id 0) do not count. The colour is the first of ``colours``
    whose red, green and blue all lie in 0..1; there is none where textures are bound but no slot of
    ``albedo``, compared without case, is.
    """
    slot = r"(?m)^\s*(?:- )?(\w+):\s*\n\s*m_Texture:\s*\{fileID:\s*(?!0[,}])-?\d+,\s*guid:\s*([0-9a-f]{32})"
    slots = F.arrays_zip(F.regexp_extract_all(text, F.lit(slot), 1).alias("slot"), F.regexp_extract_all(text, F.lit(slot), 2).alias("guid"))
    rows = df.select(F.col(id_col), F.col(text).alias("__text"), slots.alias("slots"))
    channel = lambda c, k: F.regexp_extract("__text", rf"(?m)^\s*(?:- )?_?{c.lstrip('_')}:\s*\{{[^}}]*\b{k}:\s*({NUMBER})", 1).try_cast("double")
    struct = lambda c: F.struct(*[channel(c, k).alias(k) for k in "rgba"])
    good = lambda s: reduce(lambda x, y: x & y, [s[k].between(0, 1) for k in "rgb"])
    stated = F.coalesce(*[F.when(good(struct(c)), struct(c)) for c in colours])
    hidden = (F.size("slots") > 0) & ~F.exists("slots", lambda s: F.ltrim(F.lower(s["slot"]), F.lit("_")).isin([a.lower().lstrip("_") for a in albedo]))
    return rows.select(id_col, "slots", F.when(~hidden, stated).alias("c")).select(id_col, "slots", *[F.col("c")[k].alias(k) for k in "rgba"])


def hierarchy_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """nodes, transforms and renderers of documents (path, class_id, file_id, body); renderers of lower detail are left out.

    Ids are unique within a path. A parent or an owner of 0 is null.
    """
    ref = lambda k: F.nullif(F.regexp_extract("body", rf"{k}: \{{fileID: (-?\d+)", 1).try_cast("long"), F.lit(0))
    field = lambda k: F.regexp_extract("body", rf"{k}: *(.*)", 1)
    nodes = docs.filter(F.col("class_id") == NODE).select("path", F.col("file_id").alias("node"), field("m_Name").alias("name"), (field("m_IsActive") != "0").alias("active"))
    transforms = docs.filter(F.col("class_id").isin(*TRANSFORMS)).select("path", F.col("file_id").alias("transform"), ref("m_GameObject").alias("node"), ref("m_Father").alias("parent"))
    # Each "renderers:" list of a detail document is one level; the first is the finest.
    levels = docs.filter(F.col("class_id") == LEVELS_OF_DETAIL).select("path", F.posexplode(F.slice(F.split("body", "renderers:"), F.lit(2), F.size(F.split("body", "renderers:")))).alias("level", "list"))
    lower = levels.select("path", "level", F.explode(F.regexp_extract_all("list", F.lit(r"renderer: \{fileID: (-?\d+)"), 1)).alias("renderer"))
    shown = lower.groupBy("path", F.col("renderer").cast("long").alias("renderer")).agg(F.min("level").alias("level")).filter("level > 0")
    renderers = docs.filter(F.col("class_id").isin(*RENDERERS)).select("path", F.col("file_id").alias("renderer"), ref("m_GameObject").alias("node"))
    return {"nodes": nodes, "transforms": transforms, "renderers": renderers.join(shown, ["path", "renderer"], "left_anti")}


def keyframes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, path, attribute, t, x, y, z, w, v, guid) of each key of each curve in a clip's text.

    kind is the curve section's name, lower-cased. Vectors fill x to w, single numbers v, references to
    objects guid. Sections without curves give no rows.
    """
    section = df.select(F.col(id_col), F.explode(F.split(text, r"(?m)(?=^\s*m_\w+Curves:)")).alias("section"))
    section = section.select(id_col, F.lower(F.regexp_extract("section", r"^\s*m_(\w+)Curves:", 1)).alias("kind"), "section").filter("kind <> ''")
    curve = section.select(id_col, "kind", F.posexplode(F.split("section", r"(?m)^\s*- (?=(?:serializedVersion: \d+\s+)?curve:)")).alias("k", "curve")).filter("k > 0")
    key = rf"time: ({NUMBER})\s+value: (\{{[^}}]*\}}|\S+)"
    keys = F.explode(F.arrays_zip(F.regexp_extract_all("curve", F.lit(key), 1).alias("t"), F.regexp_extract_all("curve", F.lit(key), 2).alias("value")))
    rows = curve.select(id_col, "kind", F.regexp_extract("curve", r"(?m)^\s*path: *(.*)$", 1).alias("path"), F.regexp_extract("curve", r"(?m)^\s*attribute: *(.*)$", 1).alias("attribute"), keys.alias("k"))
    axis = lambda a: F.regexp_extract("k.value", rf"\b{a}: ({NUMBER})", 1).try_cast("double").alias(a)
    return rows.select(
        id_col, "kind", "path", "attribute", F.col("k.t").cast("double").alias("t"), *[axis(a) for a in "xyzw"],
        F.col("k.value").try_cast("double").alias("v"), F.nullif(F.regexp_extract("k.value", "guid: ([0-9a-f]{32})", 1), F.lit("")).alias("guid"),
    )


def mesh_metrics(text: str | Column) -> tuple[Column, Column]:
    """(vertices, triangles) of a mesh record, from its declared count and the length of its index list in hex."""
    text = F.col(text) if isinstance(text, str) else text
    vertices = F.regexp_extract(text, r"m_VertexCount: (\d+)", 1).try_cast("long")
    width = F.when(F.regexp_extract(text, r"m_IndexFormat: (\d)", 1) == "1", 4).otherwise(2)
    return vertices, F.floor(F.length(F.regexp_extract(text, r"m_IndexBuffer: ([0-9a-fA-F]*)", 1)) / 2 / width / 3)


def manifest_entries(df: DataFrame, text: str, stem: str | Column) -> DataFrame:
    """(bundle, project_path) of each key of ``m_Container`` of each manifest in JSON.

    The bundle is ``m_AssetBundleName``, or ``stem`` where that is missing or empty. Text that does not
    parse, and manifests without a container, give no rows.
    """
    m = F.from_json(text, "m_AssetBundleName string, m_Container map<string, string>")
    rows = df.select(F.col(stem).alias("__stem") if isinstance(stem, str) else stem.alias("__stem"), m.alias("__m")).filter("__m.m_Container is not null")
    bundle = F.coalesce(F.nullif(F.col("__m.m_AssetBundleName"), F.lit("")), F.col("__stem"))
    return rows.select(bundle.alias("bundle"), F.explode(F.map_keys("__m.m_Container")).alias("project_path"))


def read_manifest_entries(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, project_path) of all manifests ``*.json`` below ``root``, each one JSON object."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return manifest_entries(files.select("value", F.regexp_extract("_metadata.file_path", r"([^/]*)\.json$", 1).alias("stem")), "value", "stem")


def hierarchy_details(docs: DataFrame) -> dict[str, DataFrame]:
    """meshes, materials and local places of documents (path, class_id, file_id, body), beside ``hierarchy_tables``.

    meshes: (path, node, mesh) with the mesh's guid. materials: (path, node, slot, material), slots from 0,
    without unbound ones. places: (path, transform, node, position, rotation, scale) as arrays; the identity
    where a record states none.
    """
    node = F.regexp_extract("body", r"m_GameObject: \{fileID: (-?\d+)", 1).try_cast("long").alias("node")
    mesh = F.regexp_extract("body", r"m_Mesh:\s*\{fileID:\s*-?\d+,\s*guid:\s*([0-9a-f]{32})", 1)
    meshes = docs.filter(F.col("class_id").isin(33, 137)).select("path", node, mesh.alias("mesh")).filter("mesh <> ''")
    listed = F.regexp_extract("body", r"m_Materials:\s*\n((?:\s*- \{fileID:[^\n]*\n?)*)", 1)
    slots = docs.filter(F.col("class_id").isin(23, 137)).select("path", node, F.posexplode(F.regexp_extract_all(listed, F.lit(r"- (\{fileID:[^\n]*)"), 1)).alias("slot", "ref"))
    materials = slots.select("path", "node", "slot", F.regexp_extract("ref", "guid:\\s*([0-9a-f]{32})", 1).alias("material")).filter("material <> ''")
    part = lambda k, axes, other: F.coalesce(
        F.when(F.col("body").rlike(rf"{k}:\s*\{{"), F.array(*[F.regexp_extract("body", rf"{k}:\s*\{{[^}}]*\b{a}:\s*({NUMBER})", 1).try_cast("double") for a in axes])), F.array(*map(F.lit, other))
    )
    places = docs.filter(F.col("class_id").isin(*TRANSFORMS)).select(
        "path", F.col("file_id").alias("transform"), node, part("m_LocalPosition", "xyz", (0.0, 0.0, 0.0)).alias("position"),
        part("m_LocalRotation", "xyzw", (0.0, 0.0, 0.0, 1.0)).alias("rotation"), part("m_LocalScale", "xyz", (1.0, 1.0, 1.0)).alias("scale"),
    )
    return {"meshes": meshes, "materials": materials, "places": places}


def scoped(text: str | Column, opens: str, closes: str) -> Column:
    """What stands between the first ``opens`` and the next ``closes``, or the end; null without ``opens``."""
    text = F.col(text) if isinstance(text, str) else text
    rest = F.substr(text, F.instr(text, opens) + len(opens))
    return F.when(F.instr(text, opens) > 0, F.when(F.instr(rest, closes) > 0, F.substring_index(rest, closes, 1)).otherwise(rest))


def extract_fields(df: DataFrame, keep: list[str], text: str | Column, fields: dict[str, tuple[str, str, object]]) -> DataFrame:
    """(``keep`` columns, a column for each field): field -> (pattern with one group, type, default for no match or no such value)."""
    text = F.col(text) if isinstance(text, str) else text
    got = lambda p, kind, other: F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast(kind), F.lit(other).cast(kind))
    return df.select(*keep, *[got(*spec).alias(k) for k, spec in fields.items()])


def harvest_enums(df: DataFrame, id_col: str, text: str, body: str, member: str, buckets: list[tuple[str, str]], stop: list[str], stem: Callable[[str], Column]) -> DataFrame:
    """(id, bucket, name, member, stem): members of each named body, put in the first bucket (label, name pattern) that fits.

    ``body`` has two groups, the name and what it holds; ``member`` finds a member in that. Bodies of no
    bucket and members among ``stop`` are left out; ``stem`` folds a member's spelling.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(body), 1).alias("name"), F.regexp_extract_all(text, F.lit(body), 2).alias("held"))
    rows = df.select(id_col, F.explode(pairs).alias("e")).select(id_col, "e.name", "e.held")
    bucket = reduce(lambda rest, b: F.when(F.rlike("name", F.lit(b[1])), b[0]).otherwise(rest), reversed(buckets), F.lit(None).cast("string"))
    rows = rows.withColumn("bucket", bucket).filter("bucket is not null").withColumn("member", F.explode(F.regexp_extract_all("held", F.lit(member), 1)))
    return rows.filter(~F.col("member").isin(stop)).select(id_col, "bucket", "name", "member", stem("member").alias("stem"))


def content_markers(text: str | Column, markers: dict[str, str], span: int = 512) -> Column:
    """The names, joined by commas, of the markers that occur in the first or last ``span`` characters."""
    text = F.col(text) if isinstance(text, str) else text
    edges = F.concat(F.substring(text, 1, span), F.lit("\0"), F.right(text, F.lit(span)))
    return F.array_join(F.array_compact(F.array(*[F.when(edges.contains(m), F.lit(k)) for k, m in markers.items()])), ",")


def scan_matches(spark: SparkSession, root: str, pattern: str, group: int = 0, separator: str = "\n") -> DataFrame:
    """(path, match) of each match in each file below ``root``, read record by record; a record is never held with another."""
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.explode(F.regexp_extract_all("value", F.lit(pattern), group)).alias("match"))


def feature_totals(df: DataFrame, id_col: str, structural: list[str], suffix: str = "Count") -> DataFrame:
    """(id, features, total): fields that are neither null nor zero nor structural, in order, and the sum of those that count.

    A field counts if its name ends in ``suffix``, without case.
    """
    fields = [f for f in df.schema.fields if f.name not in (id_col, *structural)]
    empty = lambda f: F.col(f.name).cast("string") == "" if f.dataType.simpleString() == "string" else F.col(f.name).cast("double") == 0
    held = [F.when(F.col(f.name).isNotNull() & ~empty(f), F.lit(f.name)) for f in fields]
    counts = [F.coalesce(F.col(f.name).try_cast("double"), F.lit(0.0)) for f in fields if f.name.lower().endswith(suffix.lower())]
    return df.select(id_col, F.array_join(F.array_compact(F.array(*held)), ",").alias("features"), reduce(lambda a, b: a + b, counts, F.lit(0.0)).alias("total"))
