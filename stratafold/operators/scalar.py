"""Projections and predicates on names, paths, numbers and small collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of media by file extension.
MEDIA_KINDS = {
    "image": ["png", "jpg", "jpeg", "tga", "psd", "bmp", "gif"],
    "audio": ["wav", "ogg", "mp3"],
    "font": ["ttf", "otf"],
    "text": ["txt", "json", "xml", "csv"],
}


def name_tokens(name: str | Column, digits: bool = True) -> Column:
    """Lower-cased words of a name: cut at separators and before capitals, and with ``digits`` before digits."""
    seams = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    if digits:
        seams = F.regexp_replace(seams, "([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(seams), "[^a-z0-9]+"), lambda w: w != "")


def normalise_key(name: str | Column, suffix: str | list[str] = "") -> Column:
    """Letters and digits alone, lower-cased, without trailing digits, one known suffix (the first that fits) and a plural s."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "[0-9]+$", "")
    if suffix:
        key = F.regexp_replace(key, f"(?<=.)(?:{suffix if isinstance(suffix, str) else '|'.join(suffix)})$", "")
    plural = (F.length(key) > 4) & key.rlike("s$") & ~key.rlike("(ss|us|is|as)$")
    return F.when(plural, F.regexp_replace(key, "s$", "")).otherwise(key)


def deepest_label(path: str | Column, skip: list[str]) -> Column:
    """The last folder of a path that is not one to skip; null if there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.lower(p).isin(skip))
    return F.try_element_at(parts, F.lit(-1))


def label_and_parent(path: str | Column, skip: list[str]) -> tuple[Column, Column]:
    """The last folder of a path that is not one to skip, and the last but one; null where there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.lower(p).isin(skip))
    return F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))


def container_label(path: str | Column, generic: list[str]) -> Column:
    """The last folder of a file's path that is neither generic nor opens with an underscore; null if there is none."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.try_element_at(F.filter(folders, lambda p: (p != "") & ~F.startswith(p, F.lit("_")) & ~F.lower(p).isin(generic)), F.lit(-1))


def folder_after(path: str | Column, marker: str, generic: list[str]) -> Column:
    """The folder that follows ``marker``; null without one, or if it is generic."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker)
    found = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    return F.when(~F.lower(found).isin(generic) & (found != ""), found)


def first_keyword(text: str | Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The label of the first rule of which a keyword occurs in the text."""
    low = F.lower(text)
    tests = [(reduce(lambda a, b: a | b, [low.contains(k) for k in words]), label) for label, words in rules]
    return reduce(lambda rest, t: F.when(t[0], F.lit(t[1])).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def prefix_label(name: str | Column, generic: list[str], numbering: list[str], seam: str = "_") -> Column:
    """The lower-case word of three letters at least before the first seam.

    Null if it is generic, eight or more hexadecimal digits, a letter with digits, or one of the caller's
    words ``numbering``, which count what they name, alone or with digits behind it.
    """
    word = F.regexp_extract(F.lower(name), f"^([a-z][a-z0-9]{{2,}}){seam}", 1)
    counted = F.regexp_replace(word, "[0-9]+$", "")
    code = word.rlike("^[0-9a-f]{8,}$") | (F.length(counted) == 1)
    return F.when((word != "") & ~word.isin(generic) & ~code & ~counted.isin(numbering), word)


def numbering_pattern(name: str | Column) -> Column:
    """The name with each run of digits as ``#``."""
    return F.regexp_replace(name, r"\d+", "#")


def media_kind(extension: str | Column, kinds: dict[str, list[str]] | None = None) -> Column:
    """The kind whose extensions hold this one, or null."""
    low = F.lower(extension)
    tests = list((kinds or MEDIA_KINDS).items())
    return reduce(lambda rest, kv: F.when(low.isin(kv[1]), kv[0]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def rank_by_pattern(name: str | Column, patterns: list[str], deny: list[str], other: int = 5, denied: int = 9) -> Column:
    """The place of the first pattern that matches; ``denied`` for a denied name, ``other`` if none matches."""
    ranked = reduce(lambda rest, kp: F.when(F.col(name).rlike(kp[1]), kp[0]).otherwise(rest), reversed(list(enumerate(patterns))), F.lit(other))
    return F.when(reduce(lambda a, b: a | b, [F.col(name).rlike(p) for p in deny], F.lit(False)), denied).otherwise(ranked)


def ramp(value: str | Column, low: float, high: float, log: bool = False) -> Column:
    """0 up to ``low``, 1 from ``high``, straight between, on decimal logarithms if asked."""
    v, a, b = (F.log10(F.greatest(value, F.lit(1e-9))), F.log10(F.lit(low)), F.log10(F.lit(high))) if log else (F.col(value), F.lit(low), F.lit(high))
    return F.least(F.greatest((v - a) / (b - a), F.lit(0.0)), F.lit(1.0))


def first_limit(config: str | Column, keys: list[str]) -> Column:
    """The first of ``keys``, compared without case, whose value reads as an integer."""
    low = F.transform_keys(config, lambda k, v: F.lower(k))
    return F.coalesce(*[F.try_element_at(low, F.lit(k)).try_cast("int") for k in keys])


def bit_field(value: str | Column, shift: int, mask: int) -> Column:
    """Bits of a packed integer."""
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def quat_to_degrees(z: Column, w: Column) -> Column:
    """Turn about z, in degrees, of a quaternion without x and y parts."""
    return F.degrees(2 * F.atan2(z, w))


def to_display(linear: Column) -> Column:
    """A linear colour channel of 0 to 1 as a display value of 0 to 255."""
    curve = F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, 1 / 2.4) * 1.055 - 0.055)
    return F.floor(F.least(F.greatest(curve, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def name_fields(name: str | Column, seam: str = "_") -> tuple[Column, Column]:
    """(group, label) of a name ``group<seam>label``: before and after its first seam."""
    return F.substring_index(name, seam, 1), F.when(F.instr(name, seam) > 0, F.expr(f"substring(`{name}`, instr(`{name}`, '{seam}') + {len(seam)})"))


def bundle_parts(name: str | Column, marker: str = "_assets_") -> tuple[Column, Column, Column]:
    """(group, label, hash) of a file name ``group_assets_label_hash.ext``; a hash is 32 hexadecimal digits.

    Without the marker the whole stem is the group; label and hash are null where they are missing.
    """
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digest = F.nullif(F.regexp_extract(stem, "_([0-9a-f]{32})$", 1), F.lit(""))
    plain = F.regexp_replace(stem, "_[0-9a-f]{32}$", "")
    at = F.instr(plain, marker)
    return F.when(at > 0, F.substring_index(plain, marker, 1)).otherwise(plain), F.when(at > 0, F.nullif(F.substr(plain, at + len(marker)), F.lit(""))), digest


def apply_rules(df: DataFrame, label: str, aliases: DataFrame, ignored: list[str]) -> DataFrame:
    """Renames labels by ``aliases`` (alias, name, grp), adds their group, and drops ignored labels; adds no label."""
    kept = df.filter(~F.lower(label).isin(ignored))
    small = aliases.select(F.lower("alias").alias("__alias"), F.col("name").alias("__name"), "grp")
    joined = kept.join(small, F.lower(label) == F.col("__alias"), "left")
    return joined.withColumn(label, F.coalesce("__name", label)).drop("__alias", "__name")


def choose_preferred(available: str | Column, order: list[str]) -> Column:
    """The first of ``order`` that the array holds, else its smallest value."""
    listed = F.filter(F.array(*[F.lit(o) for o in order]), lambda o: F.array_contains(available, o))
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.array_min(available))


def affine_box(m: tuple, size: tuple, pivot: tuple, flip: tuple = (False, False)) -> dict[str, Column]:
    """Axis-aligned box of a rectangle under x' = a x + b y + c, y' = d x + e y + f, about its pivot.

    flip: whether each axis is mirrored about the pivot first, as booleans or columns.
    """
    a, b, c, d, e, f = m
    sign = [F.when(F.lit(k) if isinstance(k, bool) else k, -1.0).otherwise(1.0) for k in flip]
    xs = [(u - pivot[0]) * size[0] * sign[0] for u in (F.lit(0.0), F.lit(1.0))]
    ys = [(u - pivot[1]) * size[1] * sign[1] for u in (F.lit(0.0), F.lit(1.0))]
    px = [a * x + b * y + c for x in xs for y in ys]
    py = [d * x + e * y + f for x in xs for y in ys]
    return {"x0": F.least(*px), "y0": F.least(*py), "x1": F.greatest(*px), "y1": F.greatest(*py)}


def window_box(box: dict[str, Column], window: tuple) -> dict[str, Column]:
    """A box cut to a window (x0, y0, x1, y1); null corners where nothing is left."""
    x0, y0, x1, y1 = F.greatest(box["x0"], window[0]), F.greatest(box["y0"], window[1]), F.least(box["x1"], window[2]), F.least(box["y1"], window[3])
    left = (x0 < x1) & (y0 < y1)
    return {k: F.when(left, c) for k, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))}


def browse_filter(
    df: DataFrame, equal: dict[str, object] | None = None, size: tuple[str, float, float] | None = None, contains: tuple[list[str], str] | None = None, toggles: dict[str, bool] | None = None
) -> DataFrame:
    """Rows that pass all criteria: equalities, a range, a text that one of the columns holds, without case, and toggles.

    A toggle asks a boolean column to hold, or not to; null counts as not.
    """
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.coalesce(F.col(c), F.lit(False)) == on for c, on in (toggles or {}).items()]
    if size:
        tests.append(F.col(size[0]).between(size[1], size[2]))
    if contains:
        tests.append(reduce(lambda a, b: a | b, [F.lower(c).contains(contains[1].lower()) for c in contains[0]]))
    return reduce(lambda d, t: d.filter(t), tests, df)


def in_unit_range(values: str | Column) -> Column:
    """True if every element lies in 0 to 1; null for a null array."""
    return F.forall(values, lambda v: v.between(0, 1))


def group_visible(groups: DataFrame, key: str, own: Column, members: DataFrame, member_key: str, passes: Column) -> DataFrame:
    """Groups whose own test holds or of which a member passes."""
    hit = members.filter(passes).select(F.col(member_key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return groups.join(hit, groups[key] == F.col("__key"), "left").filter(own | F.col("__hit").isNotNull()).drop("__key", "__hit")


def difference_bits(vector: str | Column, bits: int) -> Column:
    """The hash of a vector: bit k is set where element k is greater than the next."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)), F.lit(0).cast("long"),
        lambda acc, k: F.shiftleft(acc, 1).bitwiseOR(F.when(F.element_at(vector, k) > F.element_at(vector, k + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))),
    )


def position_code(name: str | Column, words: dict[str, str]) -> tuple[Column, Column]:
    """(stem, position): the name's words without position words, and the code of the first of those; null without one, or without a stem.

    Two neighbouring words that make a position word together, such as ``top_left`` where ``topleft`` is
    one, count as that if the first is one by itself. Numbers at the end of the stem go; others tell names apart and stay.
    """
    codes = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    known = list(words)
    state = lambda code, stem: F.struct(code.alias("code"), stem.alias("stem"))

    def step(s: Column, x: Column) -> Column:
        word, pair = x["word"], x["pair"]
        code = F.when(s["code"].isNotNull(), s["code"]).when(word.isin(known) & pair.isin(known), codes[pair]).otherwise(codes[word])
        return state(code, F.when(word.isin(known), s["stem"]).otherwise(F.array_append(s["stem"], word)))

    def coded(tokens: Column) -> Column:
        words = F.transform(tokens, lambda w, k: F.struct(w.alias("word"), F.concat(w, F.coalesce(F.get(tokens, k + 1), F.lit(""))).alias("pair")))
        end = F.aggregate(words, state(F.lit(None).cast("string"), F.array().cast("array<string>")), step)
        return F.transform(F.array(end), lambda e: state(e["code"], F.regexp_replace(F.array_join(e["stem"], "_"), "(^|_)[0-9]+(_[0-9]+)*$", "")))[0]

    # Bound by a lambda, the words are made once for a name, not once for each mention.
    found = F.transform(F.array(name_tokens(name)), coded)[0]
    good = found["code"].isNotNull() & (found["stem"] != "")
    return F.when(good, found["stem"]), F.when(good, found["code"])
