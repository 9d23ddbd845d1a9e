"""Registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from checks import choice, evaluation, jobs, models, preparation, profiles, results, sampling, sources

MODULES = [sources, profiles, results, sampling, preparation, choice, models, evaluation, jobs]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
