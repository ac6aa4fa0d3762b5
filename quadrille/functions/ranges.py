"""Even splits of 0 .. n - 1 and ranges written as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boards import lit


def _split(n: Column, parts: Column) -> tuple[Column, Column]:
    return F.call_function("div", n, parts), n % parts


def even_range(n: Column, parts: Column, part: Column) -> tuple[Column, Column]:
    """First and end (exclusive) of a part; the first n mod parts parts hold one more. Null unless 0 <= part < parts and n >= 0."""
    each, more = _split(n, parts)
    ok = (n >= 0) & (part >= 0) & (part < parts)
    low = each * part + F.least(more, part)
    return F.when(ok, low), F.when(ok, low + each + F.when(part < more, lit(1)).otherwise(lit(0)))


def owner(n: Column, parts: Column, index: Column) -> Column:
    """The part that holds an index; null unless 0 <= index < n and parts > 0."""
    each, more = _split(n, parts)
    longer = (each + 1) * more  # before it, parts hold one more
    of = F.when(index < longer, F.call_function("div", index, each + 1)).otherwise(more + F.call_function("div", index - longer, each))
    return F.when((index >= 0) & (index < n) & (parts > 0), of)


def read_range(text: Column, total: Column) -> tuple[Column, Column]:
    """First and end of `lo:hi`, either of which may be left out; null unless 0 <= lo <= hi <= total."""
    part = lambda k: F.regexp_extract(text, r"^(\d{0,18}):(\d{0,18})$", k)
    low = F.when(part(1) == "", lit(0)).otherwise(part(1).try_cast("long"))
    high = F.when(part(2) == "", total).otherwise(part(2).try_cast("long"))
    ok = F.coalesce(text.rlike(r"^\d{0,18}:\d{0,18}$") & (low <= high) & (high <= total), F.lit(False))
    return F.when(ok, low), F.when(ok, high)
