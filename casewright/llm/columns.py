"""Column helpers shared by the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often, and in whatever loop, body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
    """What ``step(state, item)`` gives for each item: its struct is (state, out), and a null out is left out.

    ``start`` and all states have one type.  An array grows by copying, so items are taken in runs of about the square
    root of their number: n items cost n^1.5, not n^2.
    """
    none, nested = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")

    def one(acc: Column, x: Column) -> Column:
        made = lambda r: F.struct(r.state.alias("state"), F.when(r.out.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(r.out))).alias("out"))
        return let(step(acc.state, x), made)

    def run(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc.state.alias("state"), none.alias("out")), one)
        return let(done, lambda r: F.struct(r.state.alias("state"), F.concat(acc.out, F.array(r.out)).alias("out")))

    def runs(x: Column) -> Column:
        length = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(x)))).cast("int")
        at = F.sequence(F.lit(0), F.floor(F.size(x) / length).cast("int"))
        return F.transform(at, lambda k: F.slice(x, k * length + 1, length))

    return F.aggregate(let(items, runs), F.struct(start.alias("state"), nested.alias("out")), run, lambda acc: F.flatten(acc.out))


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<at, size, part>>: the matches of ``pattern`` (never empty ones) in a text: the code point each begins
    at, its length, and the length of the group.

    Exact for any regex: the gaps between matches are what the text split at them leaves.
    """
    sizes = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), g), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = sizes(0)
    both = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), (sizes(group) if group else whole).alias("part"))

    def step(at: Column, x: Column) -> Column:
        begin = at + x.gap
        out = F.when(x["size"].isNotNull(), F.struct(begin.alias("at"), x["size"].alias("size"), x.part.alias("part")))
        return F.struct((begin + F.coalesce(x["size"], F.lit(0))).cast("int").alias("state"), out.alias("out"))

    kind = "struct<at:int,size:int,part:int>"
    return F.when(text.rlike(pattern), scan(both, F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))
