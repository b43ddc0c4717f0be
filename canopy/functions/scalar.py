"""Scalar cleaning functions as Spark Column expressions.

Every builder returns a ``Column`` made of built-in functions, so it runs
inside whole-stage codegen and the optimizer can push and prune around it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by name, safe for hostile names (blanks, dots, digits first)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _c(c: str | Column) -> Column:
    return col(c) if isinstance(c, str) else c


def first_token_lower(c: str | Column) -> Column:
    """first whitespace-separated token, lower case; no token gives NULL."""
    tok = F.regexp_extract(_c(c), r"(\S+)", 1)
    return F.lower(F.when(tok != "", tok))


def try_numeric(c: str | Column) -> Column:
    """lenient numeric parse; text that is not a number gives NULL."""
    return _c(c).try_cast("double")


def ratio_pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """num / den * 100, rounded half-to-even to ``scale`` decimals.

    Division by zero gives NULL.
    """
    return F.bround(F.try_divide(_c(num).cast("double"), _c(den).cast("double")) * 100, scale)


def fill_null(c: str | Column, value) -> Column:
    """NULL replacement."""
    return F.coalesce(_c(c), F.lit(value))


def digitize(c: str | Column, interior_edges: Sequence[float]) -> Column:
    """bucket index by interior edges, left-closed (count of edges <= x).

    A NULL input gives NULL.
    """
    x = _c(c)
    if not interior_edges:
        return F.when(x.isNotNull(), F.lit(0))
    acc = None
    for e in interior_edges:
        term = (x >= F.lit(float(e))).cast("int")
        acc = term if acc is None else acc + term
    return acc


def above(c: str | Column, threshold: float) -> Column:
    """1 if x > threshold else 0."""
    return (_c(c) > F.lit(float(threshold))).cast("int")


def strata_bin_count(n_rows: int, n_folds: int) -> int:
    """clamp(n div (2 * n_folds), 3, 10)."""
    return max(3, min(10, n_rows // (n_folds * 2)))


def strata_bin_count_col(n_rows: str | Column, n_folds: int) -> Column:
    """F7 as a Column."""
    return F.greatest(F.lit(3), F.least(F.lit(10), F.floor(_c(n_rows) / (2 * n_folds)).cast("int")))


def modulo_fold(rank0: str | Column, n_folds: int) -> Column:
    """F8: (rank0 mod k) + 1 for a 0-based rank."""
    return (F.pmod(_c(rank0), F.lit(n_folds)) + 1).cast("int")


def fold_label(fold: str | Column, n_folds: int) -> Column:
    """the last fold is shown as 'test', others as their number."""
    f = _c(fold)
    return F.when(f == n_folds, F.lit("test")).otherwise(f.cast("string"))


def fold_from_label(label: str | Column) -> Column:
    """fold label back to int; 'test' gives NULL."""
    return _c(label).try_cast("int")


def lookup_keep(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Literal-map lookup; values not in the map are kept as they are."""
    if not mapping:
        return _c(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(c)), _c(c))


def lookup_null(c: str | Column, mapping: Mapping, value_type: str | None = None) -> Column:
    """Literal-map lookup; values not in the map (and NULL) become NULL."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    x = _c(c)
    out = F.when(x.isNotNull(), F.try_element_at(m, x))
    return out.cast(value_type) if value_type else out


def constraint_feature(spec: str | Column) -> Column:
    """F12, name part: text before the last colon (whole text if none)."""
    s = _c(spec)
    return F.when(F.instr(s, ":") > 0, F.regexp_extract(s, r"^(.*):([^:]*)$", 1)).otherwise(s)


def constraint_direction(spec: str | Column) -> Column:
    """F12, direction part: int after the last colon, +1 if no colon.

    Raises (``raise_error``) for anything other than +1 / 1 / -1.
    """
    s = _c(spec)
    d = F.when(F.instr(s, ":") > 0,
               F.trim(F.regexp_extract(s, r"^(.*):([^:]*)$", 2)).try_cast("int")).otherwise(F.lit(1))
    return F.when(d.isin(1, -1), d).otherwise(
        F.raise_error(F.concat(F.lit("Invalid monotonic direction in spec: "), F.coalesce(s, F.lit("NULL"))))
    ).cast("int")


def split_list(s: str | Column, sep: str = ";") -> Column:
    """split on ``sep``, trim items, drop blanks (array result)."""
    return F.filter(F.transform(F.split(_c(s), sep), lambda x: F.trim(x)), lambda x: x != "")


def file_stem(path: str | Column) -> Column:
    """last path component without trailing slashes and last extension.

    The extension is the text after the last dot, when that dot is neither
    the first nor the last character of the component.
    """
    name = F.regexp_extract(F.regexp_replace(_c(path), "/+$", ""), r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"),
                  F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def warmup_trees(n_trees: str | Column, pct: str | Column, minimum: int = 5) -> Column:
    """max(minimum, floor(n_trees * pct))."""
    return F.greatest(F.lit(minimum), (_c(n_trees) * _c(pct)).cast("int"))


def linspace_value(lo: str | Column, hi: str | Column, i: str | Column, n: int) -> Column:
    """F16: i-th of n evenly spaced points from lo to hi, both ends included."""
    if n == 1:
        return _c(lo).cast("double")
    return _c(lo) + _c(i).cast("double") * (_c(hi) - _c(lo)) / F.lit(float(n - 1))


def signed_pct(c: str | Column, decimals: int = 1) -> Column:
    """'%+.1f%%'-style text."""
    return F.format_string(f"%+.{decimals}f%%", _c(c).cast("double"))
