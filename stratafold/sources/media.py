"""Measures of pictures and sounds, in batches of rows."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(height, width, 4) red, green, blue, alpha of Spark's order of channels."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        a = np.repeat(a, 3, axis=2)
    alpha = a[..., 3:4] if channels == 4 else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([a[..., 2::-1], alpha], axis=2)


def _measure(a: np.ndarray) -> tuple[float, bool, str | None]:
    """Share of visible pixels, whether these are grey, and their mean colour."""
    seen = a[a[..., 3] > 8][:, :3].astype(int)
    if not len(seen):
        return 0.0, False, None
    grey = float((seen.max(axis=1) - seen.min(axis=1) <= 8).mean()) > 0.95
    return len(seen) / (a.shape[0] * a.shape[1]), grey, "#" + "".join(f"{round(c):02x}" for c in seen.mean(axis=0))


def image_stats(images: DataFrame, id_col: str, image: str = "image") -> DataFrame:
    """(id, width, height, has_alpha, filled, grey, colour) of pictures as Spark's image source gives them; null pictures give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, c, raw in zip(b["h"], b["w"], b["c"], b["data"], strict=True):
                if raw is None or not h == h or h <= 0 or len(raw) != h * w * c:
                    out.append((None,) * 6)
                else:
                    a = _pixels(int(h), int(w), int(c), raw)
                    out.append((int(w), int(h), bool((a[..., 3] < 255).any()), *_measure(a)))
            got = pd.DataFrame(out, columns=["width", "height", "has_alpha", "filled", "grey", "colour"])
            yield pd.concat([b[["id"]], got.astype({"width": "Int64", "height": "Int64", "has_alpha": "boolean", "grey": "boolean"})], axis=1)

    rows = images.select(F.col(id_col).alias("id"), F.col(f"{image}.height").alias("h"), F.col(f"{image}.width").alias("w"), F.col(f"{image}.nChannels").alias("c"), F.col(f"{image}.data").alias("data"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, width int, height int, has_alpha boolean, filled double, grey boolean, colour string").withColumnRenamed("id", id_col)


def _shrunk(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over height x width equal parts of a picture; parts may share a pixel by area."""
    for axis, n in ((0, height), (1, width)):
        size = a.shape[axis]
        whole = np.concatenate([np.zeros_like(np.take(a, [0], axis)), a.cumsum(axis=axis)], axis=axis)
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(int), size - 1)
        part = (at - low).reshape([-1, 1] if axis == 0 else [1, -1])
        edge = np.take(whole, low, axis) * (1 - part) + np.take(whole, low + 1, axis) * part
        a = np.diff(edge, axis=axis) * n / size
    return a


def difference_hash(images: DataFrame, id_col: str, image: str = "image") -> DataFrame:
    """(id, hash long) of pictures as Spark's image source gives them: 64 bits, each set where one of nine columns of
    eight rows is lighter than the next; the first bit is the highest. Transparent parts are white; null pictures give null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, c, raw in zip(b["h"], b["w"], b["c"], b["data"], strict=True):
                if raw is None or not h == h or h <= 0 or w <= 0 or len(raw) != h * w * c:
                    out.append(None)
                    continue
                a = _pixels(int(h), int(w), int(c), raw).astype(float)
                grey = a[..., :3] @ np.array([0.299, 0.587, 0.114])
                grey = grey * a[..., 3] / 255 + 255 - a[..., 3]
                small = np.rint(_shrunk(grey, 8, 9))
                out.append(int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big", signed=True))
            yield pd.concat([b[["id"]], pd.DataFrame({"hash": pd.array(out, "Int64")})], axis=1)

    rows = images.select(F.col(id_col).alias("id"), F.col(f"{image}.height").alias("h"), F.col(f"{image}.width").alias("w"), F.col(f"{image}.nChannels").alias("c"), F.col(f"{image}.data").alias("data"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, hash long").withColumnRenamed("id", id_col)


def region_stats(pages: DataFrame, regions: DataFrame, page: str, region: str) -> DataFrame:
    """(page, region, inside, filled, grey, colour, digest) of each region (page, region, x, y, w, h) of a picture.

    A region travels to its page's row as an element of a list, so a picture is moved once. Regions that
    leave the page have inside false and null measures; regions of unknown pages are left out.
    """
    listed = regions.groupBy(page).agg(F.collect_list(F.struct(F.col(region).cast("string").alias("region"), *[F.col(c).cast("int").alias(c) for c in "xywh"])).alias("regions"))
    image = pages.select(F.col(page), F.col("image.height").alias("ih"), F.col("image.width").alias("iw"), F.col("image.nChannels").alias("ic"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, h, w, c, raw, parts in zip(*(b[k] for k in b.columns), strict=True):
                a = _pixels(int(h), int(w), int(c), raw)
                for r in parts:
                    inside = r["x"] >= 0 and r["y"] >= 0 and r["w"] > 0 and r["h"] > 0 and r["x"] + r["w"] <= w and r["y"] + r["h"] <= h
                    cut = np.ascontiguousarray(a[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]) if inside else None
                    measures = (*_measure(cut), hashlib.md5(cut.tobytes()).hexdigest()) if inside else (None,) * 4
                    out.append((key, r["region"], inside, *measures))
            got = pd.DataFrame(out, columns=["page", "region", "inside", "filled", "grey", "colour", "digest"])
            yield got.astype({"inside": "boolean", "grey": "boolean", "filled": "Float64"})

    joined = image.filter("data is not null").join(listed, page)
    kind = joined.schema[page].dataType.simpleString()
    got = joined.mapInPandas(run, f"page {kind}, region string, inside boolean, filled double, grey boolean, colour string, digest string")
    return got.withColumnRenamed("page", page).withColumnRenamed("region", region)


def _wave(raw: bytes) -> tuple[float, int, int] | None:
    at, rate, channels, per_second = 12, 0, 0, 0
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and at + 20 <= len(raw):
            channels, rate, per_second = struct.unpack_from("<HII", raw, at + 10)
        if name == b"data":
            return (size / per_second, rate, channels) if per_second else None
        at += 8 + size + size % 2
    return None


def _ogg(raw: bytes) -> tuple[float, int, int] | None:
    head = raw.find(b"\x01vorbis")
    last = raw.rfind(b"OggS")
    if head < 0 or len(raw) < max(head + 16, last + 14):
        return None
    channels, rate = struct.unpack_from("<BI", raw, head + 11)
    return (struct.unpack_from("<q", raw, last + 6)[0] / rate, rate, channels) if rate else None


def audio_headers(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, seconds, rate, channels) of WAV and Ogg Vorbis files, from their headers; nulls for anything else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["content"]:
                raw = raw or b""
                kind = _wave if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE" else _ogg if raw[:4] == b"OggS" else None
                out.append((kind(raw) if kind else None) or (None, None, None))
            got = pd.DataFrame(out, columns=["seconds", "rate", "channels"]).astype({"seconds": "Float64", "rate": "Int64", "channels": "Int64"})
            yield pd.concat([b[["path"]], got], axis=1)

    rows = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return rows.mapInPandas(run, "path string, seconds double, rate long, channels long").withColumnRenamed("path", path)
