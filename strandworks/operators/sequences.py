"""Preparing sequences: filters with reasons, first of each key, caps, coverage, and matched controls."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_reason(sequence: Column, alphabet: str, least: int, most: int) -> Column:
    """`ok`, or the first reason to drop an upper-cased sequence: short, long, alphabet."""
    s = F.upper(sequence)
    return F.when(sequence.isNull() | (F.length(s) < least), "short").when(F.length(s) > most, "long").when(~s.rlike(f"^[{alphabet}]+$"), "alphabet").otherwise("ok")


def first_per_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row of each key with the least ordinal; min_by folds before the shuffle, so a frequent key is no burden."""
    cols = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*cols), ordinal).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def cascade(rows: DataFrame, sequence: str, key: str, ordinal: str, alphabet: str, least: int, most: int) -> DataFrame:
    """rows with `reason`, the first that holds: short, long, alphabet, duplicate, or `ok`.

    A row is a duplicate if one of its key with a lesser ordinal passes the other checks: rows that fail them take no key.
    """
    own = rows.withColumn("reason", filter_reason(F.col(sequence), alphabet, least, most))
    first = own.where("reason = 'ok'").groupBy(key).agg(F.min(ordinal).alias("_first"))
    late = (F.col("reason") == "ok") & (F.col(ordinal) > F.col("_first"))
    return own.join(first, key, "left").withColumn("reason", F.when(late, "duplicate").otherwise(F.col("reason"))).select(*rows.columns, "reason")


def rare_letters_as_x(sequence: Column) -> Column:
    """The letters U, Z, O and B, of rare or ambiguous residues, as X."""
    return F.translate(sequence, "UZOB", "XXXX")


def round_robin(rows: DataFrame, group: str, ordinal: str, n: int) -> DataFrame:
    """n rows, taking the first of every group in name order, then the second, and so on.

    No row after a group's nth can be among them, so groups are cut to n rows before they are put in order.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(ordinal))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, or `ok`."""
    out: Column | None = None
    for name, fails in checks:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise("ok") if out is not None else F.lit("ok")


def truncated(sequence: Column, most: int) -> Column:
    return F.substring(F.upper(sequence), 1, most)


def letters_to_ids(sequence: Column, alphabet: str, first: int = 5, unknown: int = 4) -> Column:
    """Ids of the letters, from `first` on in the alphabet's order; others are `unknown`."""
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.when(F.position(c, F.lit(alphabet)) > 0, F.position(c, F.lit(alphabet)) + (first - 1)).otherwise(unknown))


def epochs_for(tokens: Column, steps: list[tuple[int, int]], otherwise: int) -> Column:
    """A step function: the value of the first bound that tokens is below."""
    out: Column | None = None
    for bound, value in steps:
        out = F.when(tokens < bound, value) if out is None else out.when(tokens < bound, value)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def _next_free(parent: list[int], i: int) -> int:
    """The first free place from i on, in the direction that parent leads to; paths are halved on the way."""
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def nearest_free(anchors: list[float], candidates: list[float]) -> list[tuple[float, float]]:
    """(anchor, control): anchors in order, each with the nearest candidate that none has taken, the lower of two as near."""
    free = sorted(candidates)
    n = len(free)
    # places 1 to n; 0 and n + 1 say that there is none on that side
    down, up = list(range(n + 2)), list(range(n + 2))
    out = []
    for a in sorted(anchors)[:n]:
        at = bisect.bisect_left(free, a) + 1
        low, high = _next_free(down, at - 1), _next_free(up, at)
        k = high if low == 0 else low if high > n or a - free[low - 1] <= free[high - 1] - a else high
        down[k], up[k] = k - 1, k + 1
        out.append((a, free[k - 1]))
    return out


def greedy_controls(anchors: DataFrame, candidates: DataFrame, group: str, key: str) -> DataFrame:
    """(group, anchor, control, gap): each anchor in turn takes the nearest candidate by `key` that none has taken.

    One group's keys are worked on together, in n log n; anchors go in order of their key, and take the lower of two
    candidates as near. Anchors that find none left have no row.
    """

    def pick(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:  # a group that one side lacks has no columns there
            return pd.DataFrame(columns=[group, "anchor", "control", "gap"])
        found = nearest_free(x[key].tolist(), y[key].tolist())
        return pd.DataFrame([(x[group].iloc[0], a, c, abs(c - a)) for a, c in found], columns=[group, "anchor", "control", "gap"])

    kind = anchors.schema[group].dataType.simpleString()
    # new columns on both sides: they may come from one table
    own, other = (df.select(F.col(group).alias(group), F.col(key).cast("double").alias(key)) for df in (anchors, candidates))
    return own.groupBy(group).cogroup(other.groupBy(group)).applyInPandas(pick, f"{group} {kind}, anchor double, control double, gap double")
