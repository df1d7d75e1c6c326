"""Canonical forms of the keys that tables share: repository names, ticket ids and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that stand for "no ticket" (fixed values).
PLACEHOLDERS = ("", "-", "n/a", "na", "none", "null", "tbd", "unknown", "todo")


def plain_repo(c: Column) -> Column:
    """``owner/name`` in lower case from any spelling: URL, scp-like remote, ``.git`` suffix, trailing slash, stray blanks. NULL if there is no such pair."""
    low = F.lower(F.regexp_replace(c, r"\s+", ""))
    low = F.regexp_replace(F.regexp_replace(low, r"/+$", ""), r"\.git$", "")
    found = F.regexp_extract(low, r"([^/:@]+/[^/:@]+)$", 1)
    return F.when(found != "", found)


def plain_snapshot(rows: DataFrame) -> DataFrame:
    """Rows with repo and base_commit (as far as they have them) in the one spelling that joins and groups need."""
    return rows.withColumns({c: f(F.col(c)) for c, f in (("repo", plain_repo), ("base_commit", commit_key)) if c in rows.columns})


def ticket_key(c: Column) -> Column:
    """A ticket id without surrounding white space and case; NULL for blank and placeholder ids."""
    low = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(~low.isin(*PLACEHOLDERS), low)


def commit_key(c: Column) -> Column:
    """A commit in lower case without white space; NULL for a blank one."""
    low = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(low != "", low)
