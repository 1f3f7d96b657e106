"""Similarity of strings as sorted tokens: 200 * LCS / (sum of lengths)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of a longest common subsequence, by rows of the usual table; built-in functions only."""
    row = lambda i: F.sequence(F.lit(1), i)

    def line(above: Column, i: Column) -> Column:
        def cell(own: Column, j: Column) -> Column:
            same = F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))
            return F.array_append(own, F.when(same, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(own, j - 1))))

        return F.reduce(row(F.length(b)), F.array(F.lit(0)), cell)

    table = F.reduce(row(F.length(a)), F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0)), line)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.get(table, F.length(b))).otherwise(0)


def indel_ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).when(total > 0, 200.0 * lcs_length(a, b) / total)


def reachable(a: Column, b: Column, cutoff: float) -> Column:
    """Whether lengths alone allow the ratio: a common subsequence is no longer than the shorter string."""
    return 200.0 * F.least(F.length(a), F.length(b)) >= cutoff * (F.length(a) + F.length(b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


# The same ratio for Arrow batches: one machine word per 64 characters of a row.


def ratio(a: str, b: str) -> float:
    """token_sort_ratio of two Python strings, by the bit-parallel LCS recurrence."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if a == b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def leaders(lists: list[list[str]], cutoffs: list[float]) -> list[int]:
    """For each entry the earliest anchor that it is like in every key, itself if there is none. Anchors are entries that are their own leader, so likeness isn't passed on."""
    out: list[int] = []
    n = len(lists[0])
    for i in range(n):
        for j in dict.fromkeys(out):
            if all(ratio(keys[j], keys[i]) >= cut for keys, cut in zip(lists, cutoffs, strict=True)):
                out.append(j)
                break
        else:
            out.append(i)
    return out


def leader_positions(keys: list[Column], cutoffs: list[float]) -> Column:
    """leaders() over arrays of one row; lists are short, so a row costs microseconds in an Arrow batch."""
    @F.pandas_udf("array<int>")
    def found(rows: pd.Series) -> pd.Series:
        return rows.map(lambda own: None if own is None else leaders([[x or "" for x in k] for k in own], cutoffs))

    return found(F.array(*keys))
