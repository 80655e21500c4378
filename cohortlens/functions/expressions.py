"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^\s*[+-]?(inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\s*$"


def to_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, digits: int = 0) -> Column:
    """Scale, round half to even, scale back: 0.575 at two digits is 0.57."""
    scale = float(10**digits)
    return F.rint(to_col(c).cast("double") * scale) / scale


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_one_of(c: str | Column, values: list) -> Column:
    return flag(to_col(c).isin(list(values)))


def number(c: str | Column, default: float | None = None) -> Column:
    """Text to double; text that is not a number is NULL, or the default."""
    text = to_col(c).cast("string")
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def label_code(c: str | Column, codes: dict[str, int]) -> Column:
    """Code of a label; a label without a code is NULL."""
    branches = [F.when(to_col(c) == label, F.lit(code)) for label, code in codes.items()]
    return F.coalesce(*branches)


def percent(part: str | Column, whole: str | Column) -> Column:
    return F.try_divide(to_col(part).cast("double"), to_col(whole)) * 100


def band_index(c: str | Column, edges: list[float]) -> Column:
    """Position of the (lo, hi] interval that holds the value; NULL outside all of them."""
    value = to_col(c)
    hits = [
        F.when((value > lo) & (value <= hi), F.lit(i))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    return F.coalesce(*hits)


def all_present(columns: list[str]) -> Column:
    """True where none of the columns is NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def fixed_text(c: str | Column, digits: int) -> Column:
    """Fixed-point text. format_number rounds the exact binary value half to even, where
    format_string would round the printed digits half up."""
    return F.replace(F.format_number(to_col(c).cast("double"), digits), F.lit(","), F.lit(""))


def percent_text(c: str | Column, digits: int = 1) -> Column:
    return F.concat(fixed_text(c, digits), F.lit("%"))


def thousands_text(c: str | Column, digits: int = 0) -> Column:
    return F.format_number(to_col(c), digits)


def slug(c: str | Column) -> Column:
    return F.lower(F.replace(to_col(c), F.lit(" "), F.lit("_")))
