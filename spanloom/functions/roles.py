"""The ordered inventory of roles and column helpers over it. The order numbers the roles and the bits of role masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names in index order.
ROLES = ["PREAMBLE", "FACTS", "ISSUE", "ARGUMENT_PLAINTIFF", "ARGUMENT_DEFENDANT", "LAW_REFERENCE", "ANALYSIS", "DECISION", "DECISION_APPEAL"]
N_ROLES = len(ROLES)


def role_name(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, ROLES)), index.cast("int"))


def bit(index: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int"))


def has(mask: Column, index: Column | int) -> Column:
    return F.call_function("shiftright", mask, F.lit(index) if isinstance(index, int) else index.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def covers(mask: Column, other: Column) -> Column:
    """Whether a mask has every role of another."""
    return mask.bitwiseAND(other) == other


def names(mask: Column, alphabetic: bool = False) -> Column:
    """The names of a mask's roles joined by +, in index or in alphabetic order."""
    order = sorted(range(N_ROLES), key=ROLES.__getitem__) if alphabetic else range(N_ROLES)
    return F.concat_ws("+", *(F.when(has(mask, r), F.lit(ROLES[r])) for r in order))
