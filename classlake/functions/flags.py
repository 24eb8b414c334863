"""Access flags and visibility as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class-file access flag masks.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL = 0x0001, 0x0002, 0x0004, 0x0008, 0x0010
BRIDGE, INTERFACE, ABSTRACT, SYNTHETIC = 0x0040, 0x0200, 0x0400, 0x1000


def has_flag(access: Column, mask: int) -> Column:
    return access.bitwiseAND(F.lit(mask)) != 0


def overridable(name: Column, private: Column, static: Column) -> Column:
    """Member that can take part in overriding."""
    return ~name.isin("<init>", "<clinit>") & ~private & ~static


def access_rank(public: Column, protected: Column, in_interface: Column) -> Column:
    """3 public or declared in an interface, 2 protected, 1 otherwise."""
    return F.when(public | in_interface, 3).when(protected, 2).otherwise(1)


def rank_flag(rank: Column) -> Column:
    """Access flag that stands for a rank."""
    return F.when(rank == 3, PUBLIC).when(rank == 2, PROTECTED).otherwise(0)


def visible_to_subclass(public: Column, protected: Column, private: Column,
                        package: Column, sub_package: Column) -> Column:
    return ~private & (public | protected | (package == sub_package))
