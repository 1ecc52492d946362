"""Working names that no column of a table has."""

from __future__ import annotations


def free(*tables) -> str:
    """A prefix longer than every column name of the tables (or lists of names), so a name that begins with it clashes with none."""
    longest = max((len(c) for t in tables for c in (t if isinstance(t, (list, tuple, set)) else t.columns)), default=0)
    return "_" * (longest + 1)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
