"""Packages, records, pictures, sounds and streams on small input written here."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from stratafold.operators import objects as O
from stratafold.operators import scalar as S
from stratafold.sources import files as D
from stratafold.sources import media as M
from stratafold.sources import packages as P
from stratafold.sources import records as R
from stratafold.streaming import inventory as T


def test_roles_and_versions(spark):
    rows = [("a/x", b"PK\x03\x04zz"), ("b/scene.txt", b"hi"), ("c", b"  {\"k\": 1}"), ("d", b"\x00\x00\x00\x05\x00\x00\x01\x00\x00\x00\x00\x16\x00\x00\x00\x00 2021.3.4f1"), ("e", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in P.sniff_role(df, "path", "content", [("zip", b"PK\x03\x04", None, 0.9), ("scene", None, r"scene\.txt$", 0.5)]).collect()}
    assert [got[k]["role"] for k in ("a/x", "b/scene.txt", "c", "d", "e")] == ["zip", "scene", "json", "unknown", "unknown"]
    assert got["a/x"]["evidence"] == ["starts with 504b0304"] and got["e"]["evidence"] == []
    more = {r["path"]: (r["v"], r["w"]) for r in df.select("path", P.header_version("content").alias("v"), P.header_words("content").alias("w")).collect()}
    assert more["d"] == ("2021.3.4f1", [5, 256, 22, 0]) and more["b/scene.txt"] == (None, None)


def test_archives(spark):
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr("lib/a.so", b"x" * 300)
        z.writestr("../out", b"y")
    df = spark.createDataFrame([("p.zip", held.getvalue()), ("bad", b"no zip"), ("none", None)], "path string, content binary")
    got = P.explode_archives(df, "path", "content").collect()
    assert {(r["path"], r["member"], r["size"], r["escapes"]) for r in got} == {("p.zip", "lib/a.so", 300, False), ("p.zip", "../out", 1, True), ("bad", None, None, None), ("none", None, None, None)}
    assert all(r["warning"] for r in got if r["member"] is None)
    assert P.explode_archives(df.limit(0), "path", "content").count() == 0


def test_text_of_older_encodings(spark):
    df = spark.createDataFrame([(1, "ağaç".encode()), (2, "ağaç".encode("cp1254")), (3, b"\x81\xe7"), (4, None)], "id long, c binary")
    assert {r["id"]: r["t"] for r in df.select("id", P.text_of("c").alias("t")).collect()} == {1: "ağaç", 2: "ağaç", 3: "\x81ç", 4: None}


def test_tilemaps(spark):
    tile = lambda name, *data, **more: {"type": "tilelayer", "name": name, "data": list(data), **more}
    several = {
        "width": 2, "height": 2, "properties": [{"name": "MaxMoves", "value": "20"}, {"name": "Time", "value": "12.0"}],
        "layers": [
            tile("Layer1", 5, 0, None, 7), tile("Layer2", 7, 7, 0, 0), tile("Paper", 1, 0), tile("Shelf", 3, 3, 4), tile("Shelf_b", 9, 9),
            {"type": "objectgroup", "name": "Spawner"}, {"type": "objectgroup", "name": "Spawner"}, {"type": "objectgroup"}, {"type": "imagelayer", "name": "Back", "properties": {"time": 3, "Wind": True}},
        ],
    }
    fullest = {"width": 1, "layers": [tile("x", 0), tile("y", 3, 1), tile("z", 3, 4), tile("y", 8)], "properties": {"time": "soon", "duration": 7.9, "moves": 7}}
    texts = [json.dumps(several), json.dumps(fullest), "no", None, "[1]", "{}", json.dumps({"layers": [tile("Grid", 1), {"type": "tilelayer"}]})]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    limits = {"time_limit": ["time", "duration"], "move_limit": ["maxmoves", "moves"]}
    got = {r["id"]: r.asDict() for r in R.parse_tilemaps(df, "id", "text", r"(?i)^(layer\d*|grid)$", "(?i)^shelf", limits).collect()}
    assert sorted(got) == [0, 1, 5, 6]
    one = {k: v for k, v in got[0].items() if k not in ("id", "properties")}
    assert one == {
        "width": 2, "height": 2, "layers": 9, "depth_layers": 2, "item_tiles": 4, "distinct_items": 2, "obstacle_layers": ["Paper"], "obstacle_tiles": 1, "shelf_tiles": 5, "shelf_types": 1,
        "object_layers": ["Spawner", "Back"], "object_groups": 4, "time_limit": 12, "move_limit": 20,
    }
    assert got[0]["properties"] == {"time": "3", "Wind": "true", "MaxMoves": "20", "Time": "12.0"} or got[0]["properties"]["Time"] in ("12", "12.0")
    assert (got[1]["depth_layers"], got[1]["item_tiles"], got[1]["obstacle_layers"], got[1]["time_limit"], got[1]["move_limit"], got[1]["height"]) == (2, 3, ["x", "z"], 7, 7, None)
    assert (got[5]["layers"], got[5]["depth_layers"], got[5]["time_limit"]) == (0, 0, None)
    assert (got[6]["depth_layers"], got[6]["item_tiles"], got[6]["obstacle_layers"]) == (1, 1, [""])


def test_region_descriptors(spark):
    old = "page.png\nsize: 64,32\nformat: X\nhead\n  rotate: true\n  xy: 2, 3\n  size: 10, 20\ntail\n  rotate: false\n  xy: 4, 4\n  size: 5, 6\n"
    new = "\np2.png\nsize: 8,8\nleaf\nbounds: 1, 2, 3, 4\nrotate: 270\n"
    lines = [(f, n, x) for f, t in (("old", old), ("new", new)) for n, x in enumerate(t.split("\n"))]
    got = R.parse_region_descriptor(spark.createDataFrame(lines, "file string, n long, line string"), "file", "n", "line").collect()
    assert {tuple(r) for r in got} == {("old", "page.png", "head", 2, 3, 10, 20, 90), ("old", "page.png", "tail", 4, 4, 5, 6, 0), ("new", "p2.png", "leaf", 1, 2, 3, 4, 270)}


def test_materials(spark):
    guid = "0f" * 16
    bound = f"    - _MainTex:\n        m_Texture: {{fileID: 2800000, guid: {guid}, type: 3}}\n    - _Bump:\n        m_Texture: {{fileID: 0}}\n"
    other = f"    - _Bump:\n        m_Texture: {{fileID: 28, guid: {guid}, type: 3}}\n"
    colours = "    - _Tint: {r: 2, g: 0, b: 0, a: 1}\n    - _Color: {r: 0.5, g: 1, b: 0, a: 1}\n"
    df = spark.createDataFrame([(1, bound + colours), (2, other + colours), (3, colours), (4, "")], "id long, text string")
    got = {r["id"]: ([(s["slot"], s["guid"]) for s in r["slots"]], r["r"]) for r in R.parse_materials(df, "id", "text", ["_MainTex"], ["_Tint", "_Color"]).collect()}
    assert got == {1: ([("_MainTex", guid)], 0.5), 2: ([("_Bump", guid)], None), 3: ([], 0.5), 4: ([], None)}


def test_hierarchy_tables(spark):
    docs = [
        ("s", 1, 10, "GameObject:\n  m_Name: root\n  m_IsActive: 0\n"), ("s", 4, 11, "Transform:\n  m_GameObject: {fileID: 10}\n  m_Father: {fileID: 0}\n"),
        ("s", 23, 12, "MeshRenderer:\n  m_GameObject: {fileID: 10}\n"), ("s", 23, 13, "MeshRenderer:\n  m_GameObject: {fileID: 10}\n"),
        ("s", 205, 14, "LODGroup:\n  m_LODs:\n  - renderers:\n    - renderer: {fileID: 12}\n  - renderers:\n    - renderer: {fileID: 13}\n    - renderer: {fileID: 12}\n"),
    ]
    got = R.hierarchy_tables(spark.createDataFrame(docs, "path string, class_id long, file_id long, body string"))
    assert [tuple(r) for r in got["nodes"].collect()] == [("s", 10, "root", False)]
    assert [tuple(r) for r in got["transforms"].collect()] == [("s", 11, 10, None)]
    assert [tuple(r) for r in got["renderers"].collect()] == [("s", 12, 10)]


def test_keyframes_and_meshes(spark):
    text = (
        "  m_PositionCurves:\n  - curve:\n      serializedVersion: 2\n      m_Curve:\n      - serializedVersion: 3\n        time: 0\n        value: {x: 1, y: -2e-1, z: 0}\n"
        "      - serializedVersion: 3\n        time: 0.5\n        value: {x: 3, y: 0, z: 0}\n    path: Body/Arm\n  m_FloatCurves:\n  - serializedVersion: 2\n    curve:\n      m_Curve:\n"
        "      - time: 1\n        value: 0.25\n    attribute: m_IsActive\n    path: Hat\n  m_ScaleCurves: []\n"
    )
    got = R.keyframes(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()
    assert {(r["kind"], r["path"], r["t"], r["x"], r["y"], r["v"]) for r in got} == {("position", "Body/Arm", 0.0, 1.0, -0.2, None), ("position", "Body/Arm", 0.5, 3.0, 0.0, None), ("float", "Hat", 1.0, None, None, 0.25)}
    vertices, triangles = R.mesh_metrics("text")
    mesh = spark.createDataFrame([("m_VertexCount: 4\nm_IndexFormat: 0\nm_IndexBuffer: " + "0000" * 6,)], "text string")
    assert tuple(mesh.select(vertices, triangles).first()) == (4, 2)


def test_pictures_and_regions(spark):
    red = bytes([0, 0, 255, 255]) * 3 + bytes([0, 0, 255, 0])
    rows = [("p", (2, 2, 4, red)), ("none", None)]
    df = spark.createDataFrame(rows, "page string, image struct<height: int, width: int, nChannels: int, data: binary>")
    got = {r["page"]: tuple(r)[1:] for r in M.image_stats(df, "page").collect()}
    assert got == {"p": (2, 2, True, 0.75, False, "#ff0000"), "none": (None,) * 6}
    regions = spark.createDataFrame([("p", "a", 0, 0, 1, 2), ("p", "b", 1, 1, 1, 1), ("p", "off", 1, 1, 2, 1), ("q", "c", 0, 0, 1, 1)], "page string, region string, x int, y int, w int, h int")
    parts = {r["region"]: (r["inside"], r["filled"], r["colour"]) for r in M.region_stats(df, regions, "page", "region").collect()}
    assert parts == {"a": (True, 1.0, "#ff0000"), "b": (True, 0.0, None), "off": (False, None, None)}


def test_sounds(spark):
    wave = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 100, 400, 4, 16) + b"data" + struct.pack("<I", 800)
    ogg = b"OggS" + bytes(24) + b"\x01vorbis" + bytes(4) + struct.pack("<BI", 1, 50) + b"OggS\0\0" + struct.pack("<q", 75) + bytes(14)
    df = spark.createDataFrame([("w", wave), ("o", ogg), ("x", b"?"), ("n", None)], "path string, content binary")
    got = {r["path"]: tuple(r)[1:] for r in M.audio_headers(df, "path", "content").collect()}
    assert got == {"w": (2.0, 100, 2), "o": (1.5, 50, 1), "x": (None,) * 3, "n": (None,) * 3}


def test_nearest_ancestor_and_siblings(spark):
    nodes = [(1, None, False), (2, 1, True), (3, 1, False), (4, 2, False), (5, 4, False), (6, 3, False), (7, 6, None)]
    got = {r["node"]: r["holder"] for r in O.nearest_ancestor(spark.createDataFrame(nodes, "n long, p long, f boolean"), "n", "p", "f").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 2, 5: 2, 6: 2, 7: 2}


def test_stream_keeps_ids_over_restarts(spark, tmp_path):
    data, folder = str(tmp_path / "in"), str(tmp_path / "state")

    def run(rows):
        spark.createDataFrame(rows, "path string, guid string").coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema("path string, guid string").parquet(data)
        return {r["path"]: r["id"] for r in T.stream_upsert(stream, folder, "id", "path", "guid").collect()}

    first = run([("a", "ga"), ("b", "gb"), (None, "x")])
    assert first == {"a": 1, "b": 2}
    assert run([("c", "gb"), ("d", "gd")]) == {"a": 1, "c": 2, "d": 3}
    stream = spark.readStream.schema("path string, guid string").parquet(data)
    again = T.stream_upsert(stream, folder, "id", "path", "guid").select(F.count("*")).first()[0]
    assert again == 3


def test_materials_of_both_shapes(spark):
    flat = """Material:
  m_SavedProperties:
    m_TexEnvs:
      _BaseMap:
        m_Texture: {fileID: 0}
        m_Scale: {x: 1, y: 1}
    m_Colors:
      _BaseColor: {r: 0.25, g: 0.5, b: 0.75, a: 2}
      _Glow: {r: 4, g: 0, b: 0, a: 0}
"""
    bound = flat.replace("m_Texture: {fileID: 0}", "m_Texture: {fileID: 2800000, guid: aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa, type: 3}")
    mask = bound.replace("_BaseMap", "_NoiseMask")
    listed = "  - _MainTex:\n      m_Texture: {fileID: 28, guid: bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb, type: 3}\n  - _Color: {r: 1.5, g: 0, b: 0, a: 1}\n  - _Tint: {r: 0, g: 1, b: 0, a: 1}\n"
    df = spark.createDataFrame([(1, flat), (2, bound), (3, mask), (4, listed), (5, None)], "id long, text string")
    got = {r["id"]: ([(s["slot"], s["guid"][0]) for s in r["slots"] or []], r["r"], r["a"]) for r in R.parse_materials(df, "id", "text", ["MainTex", "basemap"], ["BaseColor", "_Color", "_Tint"]).collect()}
    assert got == {1: ([], 0.25, 2.0), 2: ([("_BaseMap", "a")], 0.25, 2.0), 3: ([("_NoiseMask", "a")], None, None), 4: ([("_MainTex", "b")], 0.0, 1.0), 5: ([], None, None)}


def test_manifests_are_read(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"m_AssetBundleName": "first", "m_Container": {"a/b.png": {"x": 1}, "c.txt": 2}}, indent=1))
    (tmp_path / "two.json").write_text(json.dumps({"m_AssetBundleName": "", "m_Container": {"d": None}}))
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "none.json").write_text("{}")
    assert {(r["bundle"], r["project_path"]) for r in R.read_manifest_entries(spark, str(tmp_path)).collect()} == {("first", "a/b.png"), ("first", "c.txt"), ("two", "d")}
    (tmp_path / "log.txt").write_text("x=1;y=2;z\nx=3")
    assert sorted(r["match"] for r in R.scan_matches(spark, str(tmp_path / "log.txt"), r"(\w)=\d", 1, ";").collect()) == ["x", "x", "y"]


def test_types_by_extension_header_folder(spark):
    rows = [("a/x.prefab", None), ("Sprite/x.asset", "--- !u!213 &1"), ("Scenes/l.asset", "--- !u!999 &1"), ("Scenes/l.asset", None), ("Sprite/x.json", "{}"), ("q/x.json", "{}"), ("q/x", "?")]
    df = spark.createDataFrame(rows, "path string, head string")
    kind = D.infer_type("path", "head", {"prefab": "Prefab"}, {213: "Sprite"}, {"sprite": "Sprite", "scenes": "Scene"}, loose={"json": "TextAsset"})
    assert [r[0] for r in df.select(kind).collect()] == ["Prefab", "Sprite", "SerializedAsset", "Scene", "Sprite", "TextAsset", "Other"]


def test_hierarchy_details(spark):
    docs = [
        ("p", 33, 1, "  m_GameObject: {fileID: 9}\n  m_Mesh: {fileID: 43, guid: cccccccccccccccccccccccccccccccc, type: 2}\n"),
        ("p", 23, 2, "  m_GameObject: {fileID: 9}\n  m_Materials:\n  - {fileID: 21, guid: dddddddddddddddddddddddddddddddd, type: 2}\n  - {fileID: 0}\n  - {fileID: 21, guid: eeeeeeeeeeeeeeeeeeeeeeeeeeeeeeee, type: 2}\n  m_Other: 1\n"),
        ("p", 4, 3, "  m_GameObject: {fileID: 9}\n  m_LocalRotation: {x: 0, y: 0, z: 1, w: -0.5}\n  m_LocalPosition: {x: 1e2, y: -2, z: 3}\n"),
    ]
    got = {k: [tuple(r) for r in d.collect()] for k, d in R.hierarchy_details(spark.createDataFrame(docs, "path string, class_id int, file_id long, body string")).items()}
    assert got["meshes"] == [("p", 9, "c" * 32)] and sorted(got["materials"]) == [("p", 9, 0, "d" * 32), ("p", 9, 2, "e" * 32)]
    assert got["places"] == [("p", 3, 9, [100.0, -2.0, 3.0], [0.0, 0.0, 1.0, -0.5], [1.0, 1.0, 1.0])]


def test_packages_keep_the_shallowest_and_loose(spark):
    rows = [("a", "x/a.zip", True, 3), ("a", "x/a", False, 3), ("b", "y/b.zip", True, 1), ("b", "z/b", False, 2), ("b", "z/b2", False, 2), ("d", "x/y/d", False, 1), ("c", "1/2/3/4/5/c", False, 1)]
    found = lambda rows: {r["name"]: (r["path"], r["conflict"], r["copies"]) for r in P.resolve_packages(spark.createDataFrame(rows, "name string, path string, packed boolean, size long"), "name", "path", F.col("packed"), "size").collect()}
    # The first level that holds anything is read alone, and only four levels are looked at.
    assert found(rows) == {"a": ("x/a", False, 2), "b": ("z/b", True, 3)}
    assert found([("base", "base.apk", False, 1), *rows]) == {"base": ("base.apk", False, 1)}
    assert found(rows[-2:]) == {"d": ("x/y/d", False, 1)} and found(rows[-1:]) == {}


def test_empty_files_are_added(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hi")
    (tmp_path / "b.png").write_bytes(b"")
    files = D.file_inventory(spark, str(tmp_path))
    listed = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.TXT", "b.png")], "path string")
    assert {(r["stem"], r["extension"], r["size"]) for r in D.with_empty_files(files, listed, "path").collect()} == {("a", "txt", 2), ("b", "png", 0)}


def test_labels_without_hexadecimal_words(spark):
    names = ["face_1", "feed_x", "deadbeef_1", "wave4_a", "wave_b", "m139_b", "gem_x", "ab_c", "new_x"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(S.prefix_label("n", ["new"], ["wave"])).collect()
    assert [r[0] for r in got] == ["face", "feed", None, None, None, None, "gem", None, None]


def test_nested_archives_are_opened(spark):
    def packed(files):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return held.getvalue()

    raw = packed({"a.txt": "hi", "in.zip": packed({"b.txt": "yo", "deep.apk": packed({"c.txt": "!"})})})
    df = spark.createDataFrame([("x", bytearray(raw))], "path string, content binary")
    names = lambda n, largest=10**6: [(r["path"], r["member"], r["warning"] is None) for r in P.explode_archives(df, "path", "content", n, largest).collect()]
    assert names(0) == [("x", "a.txt", True), ("x", "in.zip", True)]
    assert names(1) == [("x", "a.txt", True), ("x", "in.zip", True), ("x!in.zip", "b.txt", True), ("x!in.zip", "deep.apk", True)]
    assert names(2)[-1] == ("x!in.zip!deep.apk", "c.txt", True) and names(2, 10)[-1] == ("x", "in.zip", False)


def test_picture_hash(spark):
    image = lambda a: (len(a), len(a[0]), 1, bytearray(bytes(x for row in a for x in row)))
    fall, rise = [[200 - 20 * x for x in range(9)] for _ in range(8)], [[20 * x for x in range(9)] for _ in range(8)]
    wide = [[200 - 20 * (x // 2) for x in range(18)] for _ in range(24)]
    df = spark.createDataFrame([(1, image(fall)), (2, image(rise)), (3, image(wide)), (4, None)], "id long, image struct<height: int, width: int, nChannels: int, data: binary>")
    assert {r["id"]: r["hash"] for r in M.difference_hash(df, "id").collect()} == {1: -1, 2: 0, 3: -1, 4: None}


def test_stages_stop_at_a_failure(spark, tmp_path):
    from stratafold.sources import sinks as K

    got = K.run_stages(spark, [("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 1)], "v1", str(tmp_path / "log")).collect()
    assert [(r["stage"], r["status"], (r["error"] or "")[:4]) for r in got] == [("a", "done", ""), ("b", "failed", "Zero"), ("c", "skipped", "")]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_objects_are_assembled(spark):
    sprites = spark.createDataFrame([(1, "dog", 100), (2, "dog nose", 10), (3, "dog tail", 20), (4, "cube", 50), (5, "cube 1", 50), (6, "cube 2", 50), (10, "p", 1), (11, "q", 1), (12, "r", 1), (13, "s", 1), (20, "x", 1), (21, "y", 1)], "sprite long, name string, area long")
    declared = spark.createDataFrame([(20, "A"), (21, "A"), (13, "B")], "sprite long, marker string")
    clips = spark.createDataFrame([(100, 1), (100, 2), (100, 10), (101, 10), (101, 11), (102, 11), (102, 12), (103, 12), (103, 13), (104, 4)], "clip long, sprite long")
    got = {r["sprite"]: (r["object"], r["part"], r["clip"]) for r in O.assemble_objects(sprites, declared, clips).collect()}
    assert got[1] == ("whole:1", False, 100) and got[2] == got[3] == ("whole:1", True, 100)  # cubes of one kind are no parts
    assert {got[k][0] for k in (4, 5, 6)} == {"alone:4", "alone:5", "alone:6"} and got[20] == got[21] == ("set:A", True, None)
    # 101 takes 10 and 11; 102 then shows that object; 103 takes what is still loose.
    assert got[10] == got[11] == ("clip:101", True, 101) and got[12] == got[13] == ("clip:103", True, 103)


def test_maps_are_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"layers": [], "properties": {"Time": "3.0"}}'), (2, "[1]"), (3, "{}"), (4, "{")], "id long, made string").selectExpr("id", "translate(made, '~', '') AS text")
    got = R.parse_tilemaps(df, "id", "text", "^a", "^b", {"time": ["limit", "TIME"], "moves": ["moves"]}).select("id", "time", "moves")
    assert {tuple(r) for r in got.collect()} == {(1, 3, None), (3, None, None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count(" lower(") + plan.count("(lower(") <= 1
