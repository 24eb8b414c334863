"""Row filters over names and members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed(name: Column, prefixes: list[str]) -> Column:
    """Starts with one of the prefixes; no prefix allows everything."""
    if not prefixes:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes])


def excluded(name: Column, pattern: str) -> Column:
    """The whole name matches the pattern; an empty pattern excludes nothing."""
    return name.rlike(rf"\A(?:{pattern})\z") if pattern else F.lit(False)


def implicit_enum_member(kind: Column, name: Column, descriptor: Column, owner: Column,
                         synthetic: Column, is_enum: Column | None = None) -> Column:
    """Members a compiler adds to every enum class."""
    is_enum = F.lit(True) if is_enum is None else is_enum
    self_array = F.concat(F.lit("[L"), owner, F.lit(";"))
    values = (name == "values") & (descriptor == F.concat(F.lit("()"), self_array))
    value_of = (name == "valueOf") & (
        descriptor == F.concat(F.lit("(Ljava/lang/String;)L"), owner, F.lit(";")))
    return is_enum & (((kind == "method") & (values | value_of)) | (
        (kind == "field") & synthetic & (descriptor == self_array)))
