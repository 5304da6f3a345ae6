"""Queries over the driver's tables, one or more for each operator of the inventory."""

from . import catalogue, dashboard, extraction, fields, filters, matching, more, text, values, work
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalogue", "dashboard", "extraction", "fields", "filters", "matching", "more", "text", "values", "work"]
