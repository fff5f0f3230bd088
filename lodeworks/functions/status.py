"""Column functions on processing states and loose numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What states of other systems mean here. Results and imports differ in what was skipped.
_COMMON = {"DONE": "DONE", "SUCCESS": "DONE", "PENDING": "PENDING", "PROCESSING": "PROCESSING", "ERROR": "FAILED", "FAILED": "FAILED", "FAILURE": "FAILED", "NOT_FOUND": "DONE"}
RESULT_STATES = _COMMON | {"SKIPPED": "DONE"}
IMPORT_STATES = _COMMON | {"SKIPPED": "PENDING"}
#: Reasons that make a skipped stage a failed one.
FAILING_REASONS = ("missing dependency", "missing qwen vision", "api key", "base url", "load failed", "failed:", "runtimeerror", "attributeerror")


def _mapped(c: Column, states: dict[str, str]) -> Column:
    s = F.upper(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[s], s)


def result_state(c: Column) -> Column:
    return _mapped(c, RESULT_STATES)


def import_state(c: Column, default: str = "DONE") -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(_mapped(c, IMPORT_STATES))


def worker_state(c: Column, reason: Column) -> Column:
    s, why = F.lower(F.trim(c)), F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    failing = F.lit(False)
    for marker in FAILING_REASONS:
        failing = failing | F.contains(why, F.lit(marker))
    return F.when((s == "error") | ((s == "skipped") & failing), "FAILED").otherwise(c)


def is_done(c: Column) -> Column:
    return F.upper(F.trim(c)).isin("DONE", "SUCCESS")


def finite(c: Column) -> Column:
    """As double; null where it is no number, NaN or infinite."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite_int(c: Column) -> Column:
    x = finite(c)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def first_number(*columns: Column) -> Column:
    """The first that is a number; 0 is one."""
    return F.coalesce(*[finite(c) for c in columns])
