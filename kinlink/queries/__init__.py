"""Registered queries: every operator over whole tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict[str, str]]:
    from kinlink.queries import files, inspection, linkage, normalizers, review, streams, vectors  # noqa: F401

    return QUERIES, ORACLES
