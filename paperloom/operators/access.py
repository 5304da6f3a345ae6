"""Visibility, filters and guarded casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of sensitivity, least first.
SENSITIVITY = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]

OPERATORS = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
}


def visible(docs: DataFrame, user: str, department: str | None, admin: bool = False) -> DataFrame:
    """Live rows that a user may read: all for an admin, else their own and their department's."""
    allowed = F.lit(True) if admin else (F.col("owner") == user) | (F.col("department") == department)
    return docs.where(~F.col("deleted") & allowed)


def shared_or_own(docs: DataFrame, column: str, value: str) -> DataFrame:
    return docs.where(F.col(column).isNull() | (F.col(column) == value))


def number_or_null(text: Column) -> Column:
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("decimal(18,4)"))


def date_or_null(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def contains_text(column: str, part: str) -> Column:
    """Case-insensitive containment of a literal; its wildcards have no meaning."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def half_open(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    kind = df.schema[column].dataType
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast(kind))
    return df if until is None else df.where(F.col(column) < F.lit(until).cast(kind))


def document_filters(docs: DataFrame, status=None, document_type=None, owner=None, filename=None, vendor=None, since=None, until=None) -> DataFrame:
    for column, value in (("status", status), ("document_type", document_type), ("owner", owner), ("vendor_id", vendor)):
        if value is not None:
            docs = docs.where(F.col(column) == value)
    if filename is not None:
        docs = docs.where(contains_text("filename", filename))
    return half_open(docs, "created", since, until)


def review_filters(tasks: DataFrame, state=None, task_type=None, priority=None, assigned=None, user=None, overdue_at=None) -> DataFrame:
    for column, value in (("state", state), ("task_type", task_type), ("priority", priority)):
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    if assigned == "me":
        tasks = tasks.where(F.col("assignee") == user)
    elif assigned == "unassigned":
        tasks = tasks.where(F.col("assignee").isNull())
    return tasks if overdue_at is None else tasks.where((F.col("state") == "OPEN") & (F.col("due_at") < F.lit(overdue_at).cast("timestamp")))


def audit_page(log: DataFrame, action: str | None = None, id: str = "id", action_column: str = "action", before: int | None = None, size: int = 50, stem: bool = False) -> DataFrame:
    """One row more than a page, newest first; an action that ends with a dot is a prefix (``stem``: without the dot)."""
    if action:
        prefix = action[:-1] if stem else action
        log = log.where(F.col(action_column).startswith(prefix) if action.endswith(".") else F.col(action_column) == action)
    if before is not None:
        log = log.where(F.col(id) < before)
    return log.orderBy(F.desc(id)).limit(size + 1)


def any_semi_join(df: DataFrame, id: str, sides: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that meet any of the sides: a union of semi joins, where an OR would be a nested loop."""
    parts = [df.join(side, column, "left_semi") for side, column in sides]
    return reduce(DataFrame.unionByName, parts).dropDuplicates([id])


def valid_on(df: DataFrame, day: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    at = F.lit(day).cast("date")
    return df.where((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) >= at)))


def after_retention(df: DataFrame, id: str, purge: Column) -> DataFrame:
    """What a purge leaves: rows for which the condition is not true."""
    return df.where(~F.coalesce(purge, F.lit(False)))


def rank_of(column: str | Column, order: list[str]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*map(F.lit, order)), column).cast("int")


def gate(df: DataFrame, columns: list[str], limit: str) -> DataFrame:
    """The highest of several levels, and whether it may leave: ``level, may_leave``."""
    top = F.greatest(*[rank_of(c, SENSITIVITY) for c in columns])
    return df.withColumn("level", F.element_at(F.array(*map(F.lit, SENSITIVITY)), top)).withColumn("may_leave", top <= SENSITIVITY.index(limit) + 1)
