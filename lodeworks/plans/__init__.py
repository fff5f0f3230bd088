"""Queries over the tables, each with the SQL that checks it."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All registered queries, and their SQL."""
    from . import maintenance, relations, retrieval, services, texts, timeline  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
