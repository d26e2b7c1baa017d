"""Each check module keeps its queries and oracle texts in one book."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

_PLACES = 9


class Book:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, rounded: tuple[str, ...] = ()):
        """Register a query under its function name.

        ``rounded`` names results of floating sums, whose last digits depend on the
        order of addition; both sides round them (and turn -0 into 0).
        """

        def register(function):
            name = function.__name__
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = _rounding(function, rounded) if rounded else function
            if oracle is not None:
                self.oracles[name] = _rounded_sql(oracle, rounded) if rounded else oracle
            return function

        return register


def _rounding(function, columns):
    @wraps(function)
    def run(spark, sf_dir):
        return function(spark, sf_dir).withColumns({c: F.round(c, _PLACES) + F.lit(0.0) for c in columns})

    return run


def _rounded_sql(oracle: str, columns) -> str:
    replaced = ", ".join(f"round({c}, {_PLACES}) + CAST(0 AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({oracle})"
