"""The superstep driver: a state table, a step, and an end; every state is a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import GraphError
from .durable import Stored

#: Graphs of so many edges at most run whole in one task where an operator has a kernel; larger ones run in supersteps.
LOCAL_EDGES = 1_000_000


def fits_one_task(edges: DataFrame, limit: int | None = None) -> bool:
    """Whether a graph is small enough for a kernel, by counting no further than the bound."""
    most = LOCAL_EDGES if limit is None else limit
    return most > 0 and edges.limit(most + 1).count() <= most


def supersteps(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], open_: str, *, rounds: int, name: str, beyond: Exception | None = None) -> DataFrame:
    """Applies ``step`` until no row of the state satisfies ``open_``; a state replaces the one before.

    After ``rounds`` rounds with rows still open, ``beyond`` is raised.
    """
    now = Stored(state, name)
    for k in range(rounds + 1):
        if now.df.where(open_).isEmpty():
            return now.df
        if k == rounds:
            raise beyond or GraphError(f"{name} did not settle in {rounds} rounds")
        nxt = Stored(step(now.df, k), name)
        now.drop()
        now = nxt
    return now.df
