"""Named results of an analysis, some of which are made when they are asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import DataFrame

from ..operators.selection import described


class Tables(Mapping):
    """A dict of DataFrames; a function among the values runs at the first access, so that jobs of tables that nobody reads don't run."""

    def __init__(self, made: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        # Another Tables is taken over without making its members.
        self._made = dict(made._made if isinstance(made, Tables) else made)

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(self._made[name], DataFrame):
            self._made[name] = self._made[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)

    def __or__(self, other: Mapping) -> Tables:
        return Tables(self._made | Tables(other)._made)


def descriptions(df: DataFrame, cols: list[str], kind: str = "full", prefix: str = "describe_") -> dict[str, Callable[[], DataFrame]]:
    """A table of measures for each column; the first one asked for makes all in the same passes."""
    every = cache(lambda: described(df, cols, kind))
    return {f"{prefix}{c}": lambda c=c: every().filter(f"measure = '{c}'").drop("measure") for c in cols}
