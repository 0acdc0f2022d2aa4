"""Petri nets: markings, conditions and one step of simulation as a plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut


@dataclass(frozen=True)
class PetriNet:
    """places (place), transitions (transition), arcs (arc, place, transition, is_input), marking (place, token, seq).

    ``condition`` is a Column over a transition's gathered tokens (n_tokens, tokens); ``annotation`` one over a token,
    null for identity: such an input arc takes all of its place's tokens.
    """

    places: DataFrame
    transitions: DataFrame
    arcs: DataFrame
    marking: DataFrame
    condition: Column | None = None
    annotation: Column | None = None

    def enabled(self) -> DataFrame:
        """(transition, n_tokens, tokens) of the transitions whose condition holds on their input tokens."""
        given = self.arcs.where("is_input").join(self.marking, "place").select("transition", "token")
        gathered = given.groupBy("transition").agg(F.count("*").alias("n_tokens"), F.sort_array(F.collect_list("token")).alias("tokens"))
        kind = self.marking.schema["token"].dataType.simpleString()
        every = self.transitions.select("transition").join(gathered, "transition", "left")
        every = every.select("transition", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("tokens", F.array().cast(f"array<{kind}>")).alias("tokens"))
        return every if self.condition is None else every.where(self.condition)

    def step(self) -> PetriNet:
        """Every enabled transition takes the tokens of its input places and puts copies of them into its output places.

        Transitions that share an input each get all of its tokens.
        """
        fired = cut(self.enabled(), "fired")
        emptied = self.arcs.where("is_input").join(fired.select("transition"), "transition", "left_semi").select("place").distinct()
        kept = self.marking.join(emptied, "place", "left_anti").select("place", "token")
        out = self.arcs.where("not is_input").join(fired.select("transition", F.explode("tokens").alias("token")), "transition")
        token = F.col("token") if self.annotation is None else self.annotation
        marking = kept.union(out.select("place", token.alias("token"))).withColumn("seq", F.monotonically_increasing_id())
        return replace(self, marking=cut(marking, "marking"))

    def run(self, steps: int) -> PetriNet:
        net = self
        for _ in range(steps):
            net = net.step()
        return net

    def counts(self) -> DataFrame:
        """(place, n_tokens) of every place."""
        n = self.marking.groupBy("place").agg(F.count("*").alias("n"))
        return self.places.select("place").join(n, "place", "left").select("place", F.coalesce("n", F.lit(0)).alias("n_tokens"))
