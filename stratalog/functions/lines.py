"""Lines, their numbers, and what a block of added lines carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def split_lines(text: Column) -> Column:
    """Lines without their ends; one trailing line end adds no line, empty text has none, carriage returns stay."""
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    return F.when(text == "", F.array().cast(EMPTY)).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts))


def end_line(start: Column, n: Column) -> Column:
    return F.when(n == 0, start).otherwise(start + n - 1)


def payload(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def label(commit: Column, path: Column, start: Column, end: Column, n: Column) -> Column:
    return F.format_string("%s: %s:%d-%d (%d lines)", commit, path, start, end, n)


def added_flags(old: Column, new: Column) -> Column:
    """For each new line whether the greedy forward match misses it. Stays in the JVM; meant for short files, as it slices old for each line."""
    state = F.struct(F.lit(0).alias("i"), F.array().cast("array<boolean>").alias("f"))

    def step(acc: Column, line: Column) -> Column:
        at = F.array_position(F.slice(old, acc["i"] + 1, F.size(old)), line).cast("int")
        return F.struct((acc["i"] + at).alias("i"), F.concat(acc["f"], F.array(at == 0)).alias("f"))

    return F.aggregate(new, state, step)["f"]
