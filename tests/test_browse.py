"""Clips bound to holders, browse records and samples of corpora against plain versions."""

import json
import random
from collections import Counter, defaultdict

from stratafold.operators import catalog as C
from stratafold.operators import objects as O
from stratafold.sources import records as R
from stratafold.sources import sinks


def joined(root, path):
    return path if not root else root if not path else f"{root}/{path}"


def plain_bindings(clips, holders, rigs, animators):
    rig, root, out = defaultdict(set), defaultdict(list), {}
    for h, p in rigs:
        rig[h].add(p)
    for c, h, r in sorted(set(animators)):
        root[c, h].append(r)
    for clip in {c for c, _ in clips}:
        paths, best = {p for c, p in clips if c == clip}, ()
        for place, h in sorted({(min(q for c, x, q in holders if c == clip and x == h), h) for c, h, _ in holders if c == clip})[:8]:
            for r in root[clip, h] or [None]:
                score = (1, sum(joined(r, p) in rig[h] for p in paths)) if r is not None else (0, len(paths & rig[h]))
                if not best or score > best[0]:
                    best = (score, h, r)
        if not best:
            continue
        (bound, n), h, r = best
        if not bound:
            found = {""} | {q[: -len(p) - 1] for p in paths if p for q in rig[h] if q.endswith("/" + p)}
            n, _, r = min((-sum(joined(x, p) in rig[h] for p in paths), len(x), x) for x in found)
            n = -n
        out[clip] = (h, r, bool(bound), n)
    return out


def test_clips_are_bound_to_one_holder(spark):
    rnd = random.Random(5)
    name = lambda: "/".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))
    rigs = sorted({(f"h{k}", p) for k in range(14) for p in ["", *(name() for _ in range(9))]})
    clips = sorted({(c, p) for c in range(40) for p in [*(name() for _ in range(3)), *([""] if c % 7 == 0 else [])]})
    holders = [(c, f"h{rnd.randrange(14)}", rnd.randrange(5)) for c in range(38) for _ in range(rnd.randrange(1, 14))]
    animators = [(c, h, rnd.choice(["", "a", "a/b", "c"])) for c, h, _ in holders if rnd.random() < 0.15]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = O.bind_clip_paths(make([*clips, (0, None)], "clip long, path string"), make(holders, "clip long, holder string, place long"), make(rigs, "holder string, path string"), make(animators, "clip long, holder string, root string"))
    assert {r["clip"]: (r["holder"], r["prefix"], r["bound"], r["matched"]) for r in got.collect()} == plain_bindings(clips, holders, rigs, animators)


def test_browse_records_and_interned_sets(spark):
    assets = spark.createDataFrame([(1, "b", "t2", None), (2, "c", "t1", "i"), (3, "a", "t2", "i"), (4, "d", "t1", None)], "id long, name string, kind string, image string")
    usage = spark.createDataFrame([(1, f"h{k:02d}") for k in range(40)] + [(1, "h00"), (3, "x"), (3, None)], "id long, holder string")
    copies = spark.createDataFrame([(2, 2), (3, 2)], "id long, component long")
    clip = spark.createDataFrame([(3, 7)], "id long, frames long")
    got = C.browse_table(assets, "id", "name", "kind", "image", usage, "holder", copies, details={"clip": clip}).collect()
    assert [r["id"] for r in got] == [2, 3, 4, 1]
    one = {r["id"]: r for r in got}
    assert one[1]["used"] == 40 and one[1]["used_by"] == [f"h{k:02d}" for k in range(25)] and one[3]["used_by"] == ["x"] and one[4]["used_by"] == []
    assert [one[k]["duplicate"] for k in (1, 2, 3, 4)] == [False, True, True, False] and one[3]["clip"]["frames"] == 7 and one[2]["clip"] is None
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (3, 1, "b")], "owner long, place long, item string")
    own, lists = C.interned_sets(rows, "owner", "place", "item")
    assert {r["owner"]: r["set"] for r in own.collect()} == {1: 1, 2: 2, 3: 1}
    assert sorted(map(tuple, lists.collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a")]


def test_only_sampled_files_are_read(spark, tmp_path):
    for k in range(1, 41):
        (tmp_path / "big").mkdir(exist_ok=True)
        (tmp_path / "big" / f"level{k}.json").write_text(json.dumps({"k": k}))
    names = [("big", f"{tmp_path}/big/level{k}.json") for k in range(1, 41)] + [("small", f"small/level{k}.json") for k in range(11)] + [("none", f"none/x{'y' * k}.json") for k in range(20)]
    picked = R.corpus_samples(spark.createDataFrame(names, "folder string, path string"), "folder", "path")
    assert [int(p.split("level")[1][:-5]) for p in sorted((r["path"] for r in picked.collect()), key=lambda p: int(p.split("level")[1][:-5]))] == [1, 6, 11, 16, 21, 26, 31, 36]
    read = R.read_samples(spark, picked, "path")
    assert sorted(json.loads(r["text"])["k"] for r in read.collect()) == [1, 6, 11, 16, 21, 26, 31, 36] and len(read.inputFiles()) == 8
    assert R.read_samples(spark, picked.filter("1 = 0"), "path").count() == 0


def test_the_digest_of_an_input_tells_any_change(spark):
    digest = lambda rows: sinks.provenance({"x": (spark.createDataFrame(rows, "t string"), "t")}).first()["digest"]
    rows = [("a",), ("b",), ("b",), ("c",)]
    assert digest(rows) == digest(rows[::-1]) and len({digest(rows), digest(rows[1:]), digest([*rows, ("a",)]), digest([("a",), ("b",), ("c",), ("c",)])}) == 4
    assert Counter(r["n"] for r in sinks.provenance({"x": (spark.range(0).selectExpr("CAST(id AS STRING) AS id"), "id"), "y": (spark.range(3).selectExpr("CAST(id AS STRING) AS id"), "id")}).collect()) == {0: 1, 3: 1}
