"""File trees written here, and what the sources make of them."""

from stratafold.sources import files as S


def test_inventory_and_sidecar_ids(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.y.PNG").write_bytes(b"1234")
    (tmp_path / "a b" / "x.y.PNG.meta").write_text("kind: 2\nguid: " + "0f" * 16 + "\n")
    (tmp_path / "plain").write_bytes(b"1")
    files = S.file_inventory(spark, str(tmp_path))
    got = {r["stem"]: (r["extension"], r["size"], r["guid"]) for r in S.attach_sidecar_ids(files, str(tmp_path)).collect()}
    assert got == {"x.y": ("png", 4, "0f" * 16), "plain": ("", 1, None)}


def test_documents_of_a_text_file(spark, tmp_path):
    (tmp_path / "s.unit").write_text("%head\n--- !u!1 &-25\nName: a\n--- !u!4 &7\nx\ny\n--- !u!bad\nz\n")
    got = sorted((r["class_id"], r["file_id"], r["body"]) for r in S.split_documents(spark, str(tmp_path)).collect())
    assert got == [(1, -25, "Name: a\n"), (4, 7, "x\ny\n")]
