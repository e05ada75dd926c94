"""Line hashes and multisets of them: long tables (keys, side, line_hash, count), never maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_hash(line: Column) -> Column:
    """MD5 of a line without its trailing spaces, tabs and returns."""
    return F.md5(F.regexp_replace(line, r"[ \t\r]+$", ""))


def lines_of(text: Column) -> Column:
    """The lines of a text; a final line end opens no further line."""
    parts = F.split(text, "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def text_hashes(df: DataFrame, keys: list[str], text: str, side: str) -> DataFrame:
    """(keys, side, line_hash, count) of a text column."""
    lines = df.select(*keys, F.explode(lines_of(F.col(text))).alias("line"))
    return lines.groupBy(*keys, line_hash(F.col("line")).alias("line_hash")).agg(F.count("*").alias("count")).select(*keys, F.lit(side).alias("side"), "line_hash", "count")


def total(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("count").alias("total"))


def intersection(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows that both have, with the smaller count."""
    other = right.withColumnRenamed("count", "_count")
    return left.join(other, on).withColumn("count", F.least("count", "_count")).drop("_count").filter("count > 0")


def overlap(left: DataFrame, right: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Size of the intersection, by `keys`."""
    return intersection(left, right, on).groupBy(*keys).agg(F.sum("count").alias("overlap"))


def max_merge(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.max("count").alias("count"))


def differs(left: DataFrame, right: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The keys whose multisets are not equal."""
    both = left.select(*keys, *on, F.col("count").alias("_left")).join(right.select(*keys, *on, F.col("count").alias("_right")), keys + on, "full")
    return both.filter(~F.col("_left").eqNullSafe(F.col("_right"))).select(*keys).distinct()


def split_lines(text: str) -> list[str]:
    """As `lines_of`: only line feeds part lines."""
    return text.removesuffix("\n").split("\n") if text else []


#: Cells of a table of two sequences that is kept to read the common lines from; larger ones are halved first.
KEPT_CELLS = 1 << 24


def mask_of(places: list[int]) -> int:
    return sum(1 << j for j in places)


def common_rows(old: list[int], new: list[int]) -> Iterator[int]:
    """For each beginning of `old`, a bit for each place of `new`: 0 where one more line of `new` makes the longest common part longer."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(new):
        places.setdefault(x, []).append(j)
    # a mask is as long as `new`, so only those of frequent lines are kept
    masks = {x: mask_of(at) for x, at in places.items() if len(at) > 8}
    row = every = (1 << len(new)) - 1
    for x in old:
        at = places.get(x)
        if at:
            met = row & (masks[x] if x in masks else mask_of(at))
            row = ((row + met) | (row - met)) & every
        yield row


def common_lengths(old: list[int], new: list[int]) -> np.ndarray:
    """How long the longest common part of `old` and each beginning of `new` is."""
    row = (1 << len(new)) - 1
    for row in common_rows(old, new):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(new) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(new)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_pairs(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common part, in order. Space is linear: large tables are cut at the middle of `old`, where the two halves' lengths tell the place in `new`."""
    start = 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    end = 0
    while end < min(len(old), len(new)) - start and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = old[start : len(old) - end], new[start : len(new) - end]
    head = [(i, i) for i in range(start)]
    tail = [(len(old) - k, len(new) - k) for k in range(end, 0, -1)]
    if not a or not b:
        return head + tail
    if len(a) * len(b) <= KEPT_CELLS or len(a) == 1:
        middle = pairs_of(list(common_rows(a, b)), len(b))
    else:
        half = len(a) // 2
        cut = int(np.argmax(common_lengths(a[:half], b) + common_lengths(a[half:][::-1], b[::-1])[::-1]))
        middle = common_pairs(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in common_pairs(a[half:], b[cut:])]
    return head + [(start + i, start + j) for i, j in middle] + tail


def pairs_of(rows: list[int], n_new: int) -> list[tuple[int, int]]:
    """Read backwards: a bit of 0 that the row before doesn't have is a line in common."""
    found: list[tuple[int, int]] = []
    i, j = len(rows), n_new
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((i, j))
    return found[::-1]


def diff_counts(before: str, after: str) -> tuple[int, int, list[tuple[str, str]]]:
    """Added lines, removed lines, and each as (side, line): the fewest that make `after` of `before`."""
    old, new = split_lines(before), split_lines(after)
    number: dict[str, int] = {}
    ids_old, ids_new = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    # lines that only one side has are no part of what both have
    both = set(ids_old) & set(ids_new)
    kept_old, kept_new = ([i for i, x in enumerate(side) if x in both] for side in (ids_old, ids_new))
    pairs = common_pairs([ids_old[i] for i in kept_old], [ids_new[i] for i in kept_new])
    out: list[tuple[str, str]] = []
    i = j = 0
    for a, b in [*((kept_old[a], kept_new[b]) for a, b in pairs), (len(old), len(new))]:
        out += [("-", x) for x in old[i:a]] + [("+", x) for x in new[j:b]]
        i, j = a + 1, b + 1
    return len(new) - len(pairs), len(old) - len(pairs), out


def with_line_diff(df: DataFrame, before: str, after: str) -> DataFrame:
    """`df` with added, removed and changes array<struct<side, line>>: the one step that has no relational form."""

    def diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[int, int, list[tuple[str, str]]]] = {}  # of one batch
        for pair in zip(old, new):
            if pair not in known:
                known[pair] = diff_counts(pair[0] or "", pair[1] or "")
        rows = [known[pair] for pair in zip(old, new)]
        return pd.DataFrame({"added": [r[0] for r in rows], "removed": [r[1] for r in rows], "changes": [[{"side": s, "line": x} for s, x in r[2]] for r in rows]})

    udf = F.pandas_udf(diff, "added bigint, removed bigint, changes array<struct<side:string,line:string>>")
    return df.withColumn("_diff", udf(before, after)).select("*", "_diff.*").drop("_diff")
