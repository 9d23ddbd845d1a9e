"""Column names that an operator needs, for its results and for itself."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps
from itertools import count

from pyspark.sql import DataFrame


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have one of these names, in whatever case."""
    taken = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_prefix(columns: list[str]) -> str:
    """The shortest run of ``_`` that no column name begins with."""
    prefix = "_"
    while any(column.startswith(prefix) for column in columns):
        prefix += "_"
    return prefix


def inner_names(*names: str) -> Callable:
    """For an operator that uses columns of these names inside: the caller's own columns of such a name
    go by a free one meanwhile, and come back unchanged. Arguments that end in ``_col`` may name them.
    A result of the same name takes the place of the caller's column.
    """
    taken = {name.lower() for name in names}

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            clashing = [column for column in docs.columns if column.lower() in taken]
            if not clashing:
                return operator(docs, *args, **options)
            used = {column.lower() for column in docs.columns} | taken
            free = (name for name in map("column{}".format, count()) if name not in used)
            aside = {column: next(free) for column in clashing}
            given = signature.bind(docs.withColumnsRenamed(aside), *args, **options)
            for name, value in given.arguments.items():
                if name.endswith("_col"):
                    given.arguments[name] = aside.get(value, value)
            found = operator(*given.args, **given.kwargs)
            results = {column.lower() for column in found.columns}
            found = found.drop(*[free for column, free in aside.items() if column.lower() in results])
            return found.withColumnsRenamed({free: column for column, free in aside.items()})

        return run

    return decorate
