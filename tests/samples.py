"""Helpers shared by the test files, in a module of its own name: every folder of tests has a conftest."""

from datetime import datetime

BASE = datetime(2026, 7, 1, 12, 0, 0)


def rows(df, *columns):
    """Rows as sorted tuples of the given columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
