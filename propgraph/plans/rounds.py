"""State of driver-controlled fixpoint loops."""

from __future__ import annotations

from pyspark.sql import DataFrame

from propgraph.plans.staging import discard, staged

#: Tables that a growing union holds before they are written as one.
PARTS = 8


class Rounds:
    """Writes the state of every ``every``-th round to the shared folder and reads it back.

    A state that its successor mentions twice would double the plan each round, so it is written each
    time; one that is mentioned once may run several rounds in one job. Lost executors cost the
    rounds since the last table, never the loop. With ``forget`` the loop reads nothing but the
    latest state, and the one before the last is removed as soon as its successor is written.
    """

    def __init__(self, tag: str, every: int = 1, forget: bool = False):
        self.tag, self.every, self.forget, self.count = tag, every, forget, 0
        self.held: list[DataFrame] = []
        self.parts = 1

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        if self.count % self.every:
            return df
        df = staged(df, self.tag)
        if self.forget:
            self.held.append(df)
            while len(self.held) > 2:
                discard(self.held.pop(0))
        return df

    def folded(self, seen: DataFrame, new: DataFrame) -> DataFrame:
        """The union of both, written as one table when it has gathered ``PARTS``, so that it is read in few parts."""
        self.parts += 1
        both = seen.unionByName(new)
        if self.parts < PARTS:
            return both
        self.parts = 1
        return staged(both, self.tag)
