"""Line dedup over overlapping windows of three consecutive lines, in DataFrame functions only.

The lines of a text are its parts between line feeds. Lines that are empty after trimming of spaces, tabs and
carriage returns are passed over; every three others in a row are a window, equal to another if the trimmed
lines are. Of all equal windows in the table the first stays, in the order of id, text hash and position;
the lines that any later one covers, blank ones between them included, are removed. Windows overlap, so
covered positions are merged.

Defined results: a null text stays null and has no lines; an empty text, or one of fewer than three lines that
aren't blank, stays as it is; a text covered wholly becomes empty; rows with equal id and text are one document
and get the same result; an empty table gives an empty table; other columns are carried along or not read,
whatever their names.

Windows are compared by two 64-bit hashes. A window that occurs a third of all times is counted before the
shuffle, and the rows that look its first place up are split over tasks by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

BLANK = " \t\r"


def _key(df: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """__k1 and __k2 stand for id and text and are never null."""
    text = df[text_col].cast("string")
    return {"__k1": F.xxhash64(df[id_col], text), "__k2": F.xxhash64(text, F.lit(1))}


def windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, __k1, __k2, w1, w2 (the window's hashes), start and stop (its first and last line) of all windows."""
    lines = F.transform(F.split(df[text_col].cast("string"), "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANK)).alias("x"), i.alias("i")))
    full = F.transform(F.filter(lines, lambda s: s.x != ""), lambda s: F.struct(F.xxhash64(s.x).alias("h"), s.i.alias("i")))
    listed = df.select(df[id_col].alias("id"), *[c.alias(n) for n, c in _key(df, id_col, text_col).items()], full.alias("full")).filter(F.size("full") >= 3)
    # Three copies of the list, shifted by a line each, side by side.
    third = F.arrays_zip(F.col("full").alias("a"), F.slice("full", F.lit(2), F.size("full")).alias("b"), F.slice("full", F.lit(3), F.size("full")).alias("c"))
    rows = listed.select("id", "__k1", "__k2", F.explode(F.slice(third, F.lit(1), F.size("full") - 2)).alias("w"))
    a, b, c = F.col("w.a"), F.col("w.b"), F.col("w.c")
    return rows.select("id", "__k1", "__k2", F.xxhash64(a.h, b.h, c.h).alias("w1"), F.xxhash64(c.h, a.h, b.h, F.lit(7)).alias("w2"), a.i.alias("start"), c.i.alias("stop"))


def covered_lines(df: DataFrame, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    """__k1, __k2, __covered: the positions that go, of the documents that lose any."""
    found = ws.keep(windows(df, id_col, text_col), "windows")
    place = F.struct("id", "__k2", "start")
    first = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2", F.col("first.id").alias("id0"), F.col("first.__k2").alias("k0"), F.col("first.start").alias("s0"))
    first = ws.keep(first, "first")
    at_first = F.col("id").eqNullSafe(F.col("id0")) & (F.col("__k2") == F.col("k0")) & (F.col("start") == F.col("s0"))
    later = found.join(first, ["w1", "w2"]).filter(~at_first)
    lines = later.select("__k1", "__k2", F.explode(F.sequence("start", "stop")).alias("line"))
    return lines.groupBy("__k1", "__k2").agg(F.collect_set("line").alias("__covered"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("__lines", "__removed")) -> DataFrame:
    """The columns of ``df`` with the text without later occurrences, and two more, by ``names``: how many lines
    the text had and how many went. Columns of those names that ``df`` has give way to them."""
    ws = Workspace(df.sparkSession, "lines")
    covered = covered_lines(df, id_col, text_col, ws).withColumnsRenamed({"__k1": "__c1", "__k2": "__c2"})
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    # Other columns as one, so that no name meets another. Split below the join: above it, the lines are a column
    # and not an expression that each use repeats.
    rest = F.struct(*[df[c] for c in kept if c != text_col]).alias("__rest")
    split = df.select(rest, *[c.alias(n) for n, c in _key(df, id_col, text_col).items()], F.split(df[text_col].cast("string"), "\n").alias("__all"))
    joined = split.join(covered, (split["__k1"] == covered["__c1"]) & (split["__k2"] == covered["__c2"]), "left")
    n = F.size("__all")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__covered"))
    text = F.when(F.col("__covered").isNull(), F.array_join("__all", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__all"), i)), "\n"))
    columns = [(text if c == text_col else F.col("__rest").getField(c)).alias(c) for c in kept]
    return joined.select(*columns, F.coalesce(n, F.lit(0)).cast("long").alias(names[0]), F.coalesce(F.size("__covered"), F.lit(0)).cast("long").alias(names[1]))
