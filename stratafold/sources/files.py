"""Trees of files as tables: inventories, sidecar ids and documents inside text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, root: str, pattern: str = "*", sidecar: str = ".meta") -> DataFrame:
    """(path, stem, extension, size) of each file below ``root`` that is no sidecar; contents are not read.

    Spark's reader does not list files of no bytes; ``with_empty_files`` adds them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.col("length").alias("size"))
    return rows.filter(~F.endswith("path", F.lit(sidecar)))


def attach_sidecar_ids(files: DataFrame, root: str, sidecar: str = ".meta", pattern: str = r"^guid: *([0-9a-f]{32})") -> DataFrame:
    """``files`` with the id that a line of ``<path><sidecar>`` states; null without one, the smallest of several."""
    notes = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{sidecar}").load(root)
    owner = F.expr(f"left(path, length(path) - {len(sidecar)})").alias("path")
    ids = notes.select(owner, F.explode(F.regexp_extract_all(F.col("content").cast("string"), F.lit(f"(?m){pattern}"), 1)).alias("guid"))
    return files.join(ids.groupBy("path").agg(F.min("guid").alias("guid")), "path", "left")


def split_documents(spark: SparkSession, root: str, separator: str = "--- !u!", header: str = r"^(\d+) &(-?\d+)") -> DataFrame:
    """(path, class_id, file_id, body) of each document with a readable header; others are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(root)
    parts = rows.select(F.col("_metadata.file_path").alias("path"), *[F.regexp_extract("value", header, k).try_cast("long").alias(c) for k, c in ((1, "class_id"), (2, "file_id"))], F.regexp_replace("value", r"^[^\n]*\n?", "").alias("body"))
    return parts.filter("class_id is not null and file_id is not null")


def with_empty_files(files: DataFrame, listed: DataFrame, path: str) -> DataFrame:
    """``files`` (path, stem, extension, size) and, with size 0, the paths of ``listed`` that it lacks, such as a storage listing's."""
    lacking = listed.select(F.col(path).alias("path")).distinct().join(files, "path", "left_anti")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.unionByName(lacking.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.lit(0).cast("long").alias("size")))


def infer_type(
    path: str | Column, head: str | Column, extensions: dict[str, str], declared: dict[int, str], folders: dict[str, str],
    header: str = r"--- !u!(\d+) &", container: str = "asset", unknown: str = "SerializedAsset", loose: dict[str, str] | None = None, other: str = "Other",
) -> Column:
    """The type of a file: by its extension; for a ``container`` by the id that its head declares, else ``unknown``;
    else by the first of its folders that has a type; else by the extension among ``loose``; else ``other``.

    A container whose head cannot be read (null) may still go by its folder. Extensions and folders are compared without case.
    """
    path, head = (F.col(c) if isinstance(c, str) else c for c in (path, head))
    look = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None).cast("string")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    parts = F.split(F.lower(path), "/")
    inside = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(list(folders)))
    stated = look(declared, F.regexp_extract(F.substring(head, 1, 256), header, 1).try_cast("int"))
    boxed = extension == container
    by_folder = look(folders, F.try_element_at(inside, F.lit(1)))
    return F.coalesce(look(extensions, extension), F.when(boxed & head.isNotNull(), F.coalesce(stated, F.lit(unknown))), by_folder, F.when(boxed, unknown), look(loose or {}, extension), F.lit(other))
