"""The immutable dependency graph of an app: sources with values, cells with functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..operators.relation import Relation
from ..types import EngineError, hint
from .digest import Digest, of_value
from .lineage import Reads

Compute = Callable[[dict[str, object]], object]


@dataclass(frozen=True)
class Source:
    name: str
    value: object
    kind: str | None = None  # declared type of a scalar
    digest: Digest | None = None


@dataclass(frozen=True)
class Cell:
    """``reads`` narrows what the function looks at, by input; an absent input is read whole."""

    name: str
    inputs: tuple[str, ...]
    compute: Compute
    reads: dict[str, Reads] = field(default_factory=dict)
    place: str = "server"


class Graph:
    """Cells in an order in which every input comes first, with heights."""

    def __init__(self, sources: list[Source], cells: list[Cell]) -> None:
        self.sources = {s.name: s if s.digest else replace(s, digest=of_value(s.value)) for s in sources}
        self.cells = {c.name: c for c in cells}
        names = [*(s.name for s in sources), *(c.name for c in cells)]
        if twice := next((n for n in names if names.count(n) > 1), None):
            raise EngineError(f"two things are called `{twice}`")
        for cell in cells:
            for needed in cell.inputs:
                if needed not in names:
                    raise EngineError(f"cell `{cell.name}` reads `{needed}`, which does not exist" + hint(needed, names))
        self.order, self.height = self._sort()
        self.readers: dict[str, list[str]] = {n: [] for n in names}
        for name in self.order:
            for needed in dict.fromkeys(self.cells[name].inputs):
                self.readers[needed].append(name)

    def _sort(self) -> tuple[list[str], dict[str, int]]:
        height = dict.fromkeys(self.sources, 0)
        waiting = dict(self.cells)
        order: list[str] = []
        while waiting:
            ready = [n for n, c in waiting.items() if all(i in height for i in c.inputs)]
            if not ready:
                raise EngineError("cells depend on each other in a circle: " + ", ".join(sorted(self._circle(waiting))))
            for n in ready:
                height[n] = 1 + max((height[i] for i in waiting[n].inputs), default=0)
                order.append(n)
                del waiting[n]
        return sorted(order, key=lambda n: height[n]), height

    def _circle(self, waiting: dict[str, Cell]) -> set[str]:
        """Cells of a circle, without those that merely depend on one."""
        left = dict(waiting)
        while drop := [n for n in left if not any(n in left[o].inputs for o in left)]:
            for n in drop:
                del left[n]
        return set(left)

    def downstream(self, changed: set[str]) -> list[str]:
        """Every cell that depends on one of ``changed``, inputs first."""
        reached = set(changed)
        for name in self.order:
            if reached.intersection(self.cells[name].inputs):
                reached.add(name)
        return [n for n in self.order if n in reached]

    def with_sources(self, values: dict[str, object]) -> Graph | None:
        """The same graph over new source values; None if none of them differs."""
        made = {}
        for name, value in values.items():
            if name not in self.sources:
                raise EngineError(f"there is no source `{name}`" + hint(name, list(self.sources)))
            digest = of_value(value)
            if digest != self.sources[name].digest:
                made[name] = replace(self.sources[name], value=value, digest=digest)
        if not made:
            return None
        return Graph([made.get(n, s) for n, s in self.sources.items()], list(self.cells.values()))

    # -- placement: a page may run the cells that hang on nothing but what is already there
    def split(self) -> tuple[list[str], list[str]]:
        """(server cells, page cells); a page cell may not feed a server cell."""
        for name in self.order:
            cell = self.cells[name]
            if cell.place == "server" and (page := [i for i in cell.inputs if i in self.cells and self.cells[i].place == "page"]):
                raise EngineError(f"cell `{name}` runs on the server but reads `{page[0]}`, which is placed on the page")
        server = [n for n in self.order if self.cells[n].place == "server"]
        return server, [n for n in self.order if self.cells[n].place == "page"]

    def is_local(self, name: str) -> bool:
        """Whether a page can compute a cell by itself: it and all it hangs on are placed there, or are inputs that the page sets."""
        if name in self.sources:
            return not isinstance(self.sources[name].value, Relation)
        cell = self.cells[name]
        return cell.place == "page" and all(self.is_local(i) for i in cell.inputs)

    def frontier(self) -> list[str]:
        """What the page needs from the server: inputs of page cells that are not page cells."""
        _, page = self.split()
        needed = [i for n in page for i in self.cells[n].inputs if i not in page]
        return list(dict.fromkeys(needed))
