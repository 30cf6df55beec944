"""Archives read by seeking: equal to whole contents, nested, torn, by stretches, and beyond two gigabytes."""

import io
import zipfile

from stratafold.sources import archives as A
from stratafold.sources import packages as P


def test_archives_are_read_by_seeking(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.txt", "inside")
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(25):
            z.writestr(f"f{k}.bin", bytes([k]) * 500)
        z.writestr("../out", "x")
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "sub" / "torn.zip").write_bytes(b"PK no archive")
    (tmp_path / "note.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "sub" / "none.zip", "w"):
        pass
    # An archive behind 2.2 GB of a hole in the file.
    with open(tmp_path / "big.zip", "wb") as f:
        f.truncate(2_200_000_000)
    with zipfile.ZipFile(tmp_path / "big.zip", "a") as z:
        z.writestr("end.txt", "far")
    got = A.read_archives(spark, str(tmp_path), nested=1)
    assert got.rdd.getNumPartitions() == 4
    rows = got.collect()
    small = [("a.zip", str(tmp_path / "a.zip")), ("torn", str(tmp_path / "sub" / "torn.zip"))]
    df = spark.createDataFrame([(p, open(p, "rb").read()) for _, p in small], "path string, content binary")
    want = P.explode_archives(df, "path", "content", 1).collect()
    plain = lambda r: (r["path"], r["member"], r["size"], r["crc"], bytes(r["head"] or b""), r["escapes"], r["warning"] is None)
    assert sorted((plain(r) for r in rows if "big" not in r["path"]), key=str) == sorted(map(plain, want), key=str)
    assert [(r["member"], bytes(r["head"])) for r in rows if "big" in r["path"]] == [("end.txt", b"far")]
    # Stretches of members are partitions of their own, and lose none.
    cut = A.read_archives(spark, str(tmp_path), nested=1, stretch=10)
    assert cut.rdd.getNumPartitions() == 6 and sorted(map(plain, cut.collect()), key=str) == sorted(map(plain, rows), key=str)
    assert A.read_archives(spark, str(tmp_path / "sub"), glob="*.7z").count() == 0
