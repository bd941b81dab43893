"""A ledger of cached tables with a byte budget; the least recently used go first.

A table that goes is only no longer kept: whoever reads it computes it again.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable

from pyspark.sql import DataFrame


class CacheLedger:
    def __init__(self, budget_bytes: int) -> None:
        self.budget = budget_bytes
        self._held: OrderedDict[Hashable, tuple[DataFrame, int]] = OrderedDict()

    @staticmethod
    def size_of(df: DataFrame) -> int:
        """What a cached table takes once it was read, and the optimizer's estimate before that."""
        return int(str(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    @property
    def used(self) -> int:
        return sum(size for _, size in self._held.values())

    def names(self) -> list[Hashable]:
        """From the one that would go first."""
        return list(self._held)

    def hold(self, name: Hashable, df: DataFrame) -> list[Hashable]:
        """Keep a table under a name and return the names that had to go for it; one larger than the budget goes itself."""
        self.drop(name)
        self._held[name] = (df.cache(), self.size_of(df))
        gone = []
        while self.used > self.budget:
            oldest = next(iter(self._held))
            self.drop(oldest)
            gone.append(oldest)
        return gone

    def touch(self, name: Hashable) -> None:
        if name in self._held:
            self._held.move_to_end(name)

    def drop(self, name: Hashable) -> None:
        if name in self._held:
            self._held.pop(name)[0].unpersist()
