"""What may be added from outside: functions for SQL, recipes over small frames, and sources of time; each under its own name, once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession


@dataclass
class Registry:
    """Names and what stands behind them."""

    functions: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    recipes: dict[str, tuple[Callable, str, Callable[[list[str]], str | None]]] = field(default_factory=dict)
    times: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)

    def _new(self, where: dict, name: str, what) -> None:
        if name in where:
            raise ValueError(f"{name} is registered already")
        where[name] = what

    def function(self, name: str, arguments: str, result: str, body: str) -> None:
        """A SQL expression under a name that queries may use."""
        self._new(self.functions, name, (arguments, result, body))

    def recipe(self, name: str, schema: str, available: Callable[[list[str]], str | None] = lambda columns: None):
        """Decorator: a function from a pandas frame (one group, small) to a frame of ``schema``; ``available`` gives the reason why columns
        don't suffice, or none."""

        def keep(f: Callable) -> Callable:
            self._new(self.recipes, name, (f, schema, available))
            return f

        return keep

    def time(self, kind: str, at: Callable[[DataFrame], Column]) -> None:
        """The column that says when a row of a kind of table happened."""
        self._new(self.times, kind, at)

    def install(self, spark: SparkSession) -> list[str]:
        """Makes the functions known to a session."""
        for name, (arguments, result, body) in self.functions.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
        return sorted(self.functions)

    def run(self, name: str, groups: DataFrame, by: list[str]) -> DataFrame:
        """A recipe on every group of a grouped (small) table; raises with the reason if it isn't available for its columns."""
        f, schema, available = self.recipes[name]
        why = available(groups.columns)
        if why:
            raise ValueError(f"{name}: {why}")
        return groups.groupBy(*by).applyInPandas(f, schema)
