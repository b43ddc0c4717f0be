"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once.  What a lambda names from outside is computed
    again for each element, unless it is a column of the input or a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_before(values: Column, combine: Callable[[Column, Column], Column], zero: Column, block: int = 256) -> Column:
    """For each element of an array the combination of those before (``zero`` for the first), in blocks, so that a
    long array costs far less than its square.  ``combine`` is associative, with ``zero`` as neutral element."""
    def scan(xs: Column) -> Column:  # [zero, x0, x0 + x1, ...]
        return F.aggregate(xs, F.array(zero), lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x))))

    def of(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(block))
        return let(F.transform(starts, lambda s: scan(F.slice(xs, s, block))), lambda blocks: let(
            scan(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda offsets: F.flatten(F.transform(
                blocks, lambda b, j: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: combine(F.get(offsets, j), x))))))

    return let(values, of)


def sums_before(lengths: Column, block: int = 256) -> Column:
    """For each element of an array of longs the sum of those before."""
    return scan_before(lengths, lambda a, x: a + x, F.lit(0).cast("long"), block)


def clusters(spans: Column) -> Column:
    """Spans (structs with start and end, ordered by start) as an array of arrays: a cluster ends where no span
    before reaches over the next one's start."""
    def of(xs: Column) -> Column:
        reach = scan_before(F.transform(xs, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(-1).cast("long"))
        first = let(reach, lambda r: F.filter(F.transform(xs, lambda x, i: F.when(x["start"] >= F.get(r, i), i).otherwise(-1)),
                                              lambda i: i >= 0))
        return let(first, lambda at: F.transform(at, lambda a, j: F.slice(
            xs, a + 1, F.coalesce(F.get(at, j + 1), F.size(xs)) - a)))

    return let(spans, of)


#: Code points of the pieces that ``cut_text`` reads a text in.
PIECE = 2048


def cut_text(text: Column, cuts: Column, between: Callable[[Column], Column]) -> Column:
    """``text`` with each cut (start, end; disjoint, in order) replaced by what ``between`` makes of it.

    The text is taken apart into pieces of ``PIECE`` code points once, and what lies between two cuts is put together
    from them: finding a place in a long text again for every cut would cost its square."""
    size = F.lit(PIECE).cast("long")

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        head = lambda i, x: F.substring(F.coalesce(F.get(pieces, i), F.lit("")), F.lit(1), x)
        start = (F.pmod(a, size) + 1).cast("int")
        return F.when(first == last, F.substring(F.coalesce(F.get(pieces, first), F.lit("")), start, (b - a).cast("int"))).otherwise(
            F.concat(F.substring(F.get(pieces, first), start, F.lit(PIECE)),
                     F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                     head(last, F.pmod(b, size).cast("int"))))

    def of(v: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(v["c"], i - 1)["end"])
        return F.concat(
            F.array_join(F.transform(v["c"], lambda s, i: F.concat(part(v["p"], begin(i), s["start"]), between(s))), ""),
            part(v["p"], F.element_at(v["c"], -1)["end"], v["n"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    return let(F.struct(pieces.alias("p"), cuts.alias("c"), F.length(text).cast("long").alias("n")), of)
