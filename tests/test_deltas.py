"""A table kept as deltas against plain upserts of whole tables, with moved and repeated paths, merges, and a batch run twice."""

import os
import random

from stratafold.operators import incremental as I
from stratafold.streaming import inventory as T

SCHEMA = "path string, guid string, size long"


def test_deltas_equal_upserts_of_whole_tables(spark, tmp_path):
    rnd = random.Random(3)
    table = T.Deltas(spark, str(tmp_path), f"{SCHEMA}, row_id long", "row_id", fan=3)
    held: dict[int, tuple] = {}  # row_id -> (path, guid, size)
    for number in range(11):
        batch = {f"p{rnd.randrange(14)}": (f"g{rnd.randrange(12)}", rnd.randrange(99)) for _ in range(rnd.randrange(5))}
        rows = [(p, g, n) for p, (g, n) in batch.items()]
        T.merge_batch(table, spark.createDataFrame([*rows, (None, "g1", 1)], SCHEMA), number, "path", "guid")
        if number in (4, 8):  # a batch that is run again gives the same
            T.merge_batch(table, spark.createDataFrame([*rows, (None, "g1", 1)], SCHEMA), number, "path", "guid")
        top = max(held, default=0)
        old = spark.createDataFrame([(k, *v[:2]) for k, v in held.items()], "row_id long, path string, guid string")
        known = {r["row_id"]: (r["path"], r["guid"], r["size"]) for r in I.upsert(old, spark.createDataFrame(rows, SCHEMA), "row_id", "path", "guid", top=top).collect()}
        held |= known
        got = {r["row_id"]: (r["path"], r["guid"], r["size"]) for r in table.read(number).collect()}
        assert got == held
    assert len({v[0] for v in held.values()}) == len(held)
    # Folders of merged batches are gone, but for those of the last merge.
    left = {(d.split("=")[1], b.split("=")[1]) for d in os.listdir(tmp_path) for b in os.listdir(tmp_path / d)}
    assert left == {("2", "8"), ("0", "9"), ("0", "10")}
