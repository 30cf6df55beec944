"""Packages and loose files: roles by content, versions in headers, members of archives, text of unknown encoding."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file that tell its kind.
HEAD = 192


def sniff_role(df: DataFrame, path: str, content: str, rules: list[tuple[str, bytes | None, str | None, float]]) -> DataFrame:
    """``df`` with role, confidence and evidence: the first rule (role, magic bytes, path pattern, confidence) that holds.

    A rule may leave out one of the two tests. What no rule knows is ``json`` if its first character that
    is no blank opens an object or a list, else ``unknown``. Null contents match no magic bytes.
    """
    head = F.substring(content, 1, HEAD)
    role = confidence = evidence = None
    for name, magic, pattern, sure in rules:
        tests = []
        if magic is not None:
            tests.append((F.coalesce(F.startswith(head, F.lit(magic)), F.lit(False)), f"starts with {magic.hex()}"))
        if pattern is not None:
            tests.append((F.coalesce(F.rlike(F.col(path), F.lit(pattern)), F.lit(False)), f"path like {pattern}"))
        hit = tests[0][0] if len(tests) == 1 else tests[0][0] & tests[1][0]
        why = F.array(*[F.lit(text) for _, text in tests])
        first = role is None
        role = F.when(hit, name) if first else role.when(hit, name)
        confidence = F.when(hit, sure) if first else confidence.when(hit, sure)
        evidence = F.when(hit, why) if first else evidence.when(hit, why)
    json = F.coalesce(F.rlike(F.decode(head, "ISO-8859-1"), F.lit(r"^[\s]*[\[{]")), F.lit(False))
    other = F.when(json, "json").otherwise("unknown")
    if role is None:
        role, confidence, evidence = (F.lit(None).cast(t) for t in ("string", "double", "array<string>"))
    return df.select(
        "*", F.coalesce(role, other).alias("role"), F.coalesce(confidence, F.when(json, 0.5).otherwise(0.0)).alias("confidence"),
        F.coalesce(evidence, F.when(json, F.array(F.lit("opens like JSON"))).otherwise(F.array().cast("array<string>"))).alias("evidence"),
    )


def header_version(content: str, pattern: str = r"(\d+\.\d+\.\d+[a-z]\d+)") -> Column:
    """The version that the head of a binary states, null without one."""
    return F.nullif(F.regexp_extract(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"), pattern, 1), F.lit(""))


def header_words(content: str, n: int = 4) -> Column:
    """The first ``n`` big-endian unsigned 32-bit numbers; null where the content is shorter."""
    word = lambda k: F.conv(F.hex(F.substring(content, 4 * k + 1, 4)), 16, 10).cast("long")
    return F.when(F.length(content) >= 4 * n, F.array(*[word(k) for k in range(n)]))


def archive_members(where: str, archive: BinaryIO, depth: int, largest: int, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Rows of the members ``start`` to ``stop`` of an archive that can be sought in; those of archives inside it follow their own row, as ``archive!member``."""
    try:
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist()[start:stop]:
                if m.is_dir():
                    continue
                steps = m.filename.replace("\\", "/").split("/")
                with z.open(m) as f:
                    head = f.read(HEAD)
                    inner = depth > 0 and head[:4] == b"PK\x03\x04"
                    body = head + f.read() if inner and m.file_size <= largest else None
                warning = f"an archive of more than {largest} bytes is not opened" if inner and body is None else None
                yield where, m.filename, m.file_size, m.CRC, head, ".." in steps or steps[0] == "" or ":" in steps[0], warning
                if body is not None:
                    yield from archive_members(f"{where}!{m.filename}", io.BytesIO(body), depth - 1, largest)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError) as e:
        yield where, None, None, None, None, None, str(e)


def explode_archives(df: DataFrame, path: str, content: str, nested: int = 0, largest: int = 256_000_000) -> DataFrame:
    """(path, member, size, crc, head, escapes, warning) of each file in each zip; unreadable ones give one row with a warning.

    A member escapes if its path is absolute or climbs out of its archive. Only the head of a member is
    unpacked, but members that are archives themselves are opened down to ``nested`` levels, unless they
    are larger than ``largest`` bytes, which a warning tells. A null content is unreadable; an archive
    without files gives no row. Whole archives are rows here; ``archives.read_archives`` reads files by seeking.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "member", "size", "crc", "head", "escapes", "warning"]
        for b in batches:
            out = [row for where, raw in zip(b["path"], b["content"], strict=True) for row in archive_members(where, io.BytesIO(raw or b""), nested, largest)]
            got = pd.DataFrame(out, columns=columns)
            yield got.astype({"size": "Int64", "crc": "Int64", "escapes": "boolean"})

    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return rows.mapInPandas(members, "path string, member string, size long, crc long, head binary, escapes boolean, warning string")


def resolve_packages(df: DataFrame, name: str, path: str, container: Column, size: str, deepest: int = 4) -> DataFrame:
    """One row for each package name of a tree: a loose copy before one in a container, then by path.

    Only the shallowest folder level that holds any package is read; deeper ones are copies put aside. Levels
    are numbered from 0, and only the first ``deepest`` ones count. conflict tells whether the copies of a name differ in size.
    """
    deep = df.withColumn("__depth", F.size(F.split(path, "/")) - 1).filter(F.col("__depth") < deepest)
    rows = deep.filter(F.col("__depth") == deep.agg(F.min("__depth")).first()[0]).withColumn("__in", container)
    sizes = rows.groupBy(name).agg((F.min(size) < F.max(size)).alias("conflict"), F.count("*").alias("copies"))
    order = Window.partitionBy(name).orderBy("__in", path)
    best = rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__depth", "__in")
    return best.join(sizes, name)


def text_of(content: str | Column) -> Column:
    """Bytes as text: UTF-8, else Windows-1254, else Latin-1; null stays null. Only bytes that are no UTF-8 leave the JVM."""

    @F.pandas_udf("string")
    def older(raw: pd.Series) -> pd.Series:
        def read(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return bytes(b).decode("cp1254")
            except UnicodeDecodeError:
                return bytes(b).decode("latin-1")

        return raw.map(read)

    raw = F.col(content) if isinstance(content, str) else content
    good = F.is_valid_utf8(raw.cast("string"))
    return F.when(good, raw.cast("string")).otherwise(older(F.when(~good, raw)))
