"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are normalized (lower case, white space as one space).  An item may
differ from a passage in ``floor(rate * length)`` edits; cut into one piece more than
that, at least one piece must occur exactly.  All pieces go into one Aho-Corasick
automaton that runs over whole documents; every piece that is found proposes the stretch
of text where its item would lie, stretches of an item on the same diagonal are proposed
once, and Myers' bit-parallel distance decides.

An item below ``SHORT_CHARS`` normalized characters has no budget: it counts where it
stands verbatim as whole words.

Documents are mapped where they are (no shuffle).  The benchmark comes to the executors
in blocks of about ``BLOCK_CHARS`` characters, so what they hold is bounded by that or
by the longest item.  Null and blank items match nothing; null and empty texts hold
nothing.  Repeated items and repeated rows are reported each for itself.  Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

RATE = 0.08
#: Below this a normalized item counts only verbatim and as whole words.
SHORT_CHARS = 24
BLOCK_CHARS = 4_000_000


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _goes_on(text: str, a: int, b: int) -> bool:
    """Whether a word runs from place ``a`` of the text on to ``b``."""
    return 0 <= a and b < len(text) and text[a].isalnum() and text[b].isalnum()


class Pattern:
    """An item with its budget, its pieces and its bit masks."""

    def __init__(self, item_id: int | None, text: str, rate: float) -> None:
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.is_short = self.size < SHORT_CHARS
        self.budget = 0 if self.is_short else int(rate * self.size)
        n = self.budget + 1
        cuts = [self.size * k // n for k in range(n + 1)]
        self.pieces = [(text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self._masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self._masks[c] = self._masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> tuple[int, int]:
        """The least edit distance to any stretch of ``text``, and where the first such stretch ends.

        Stops as soon as what is left of the text cannot bring the distance into the budget.
        """
        full = (1 << self.size) - 1
        top = 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best, best_end, left = self.size, 0, len(text)
        masks, limit = self._masks, self.budget
        for c in text:
            left -= 1
            equal = masks.get(c, 0)
            down = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(across | plus)
            fall = plus & across
            if up & top:
                score += 1
            elif fall & top:
                score -= 1
            if score < best:
                best, best_end = score, len(text) - left
            elif score - left > limit and best > limit:
                break
            up <<= 1
            fall <<= 1
            plus = (fall | ~(down | up)) & full
            minus = up & down & full
        return best, best_end


class Matcher:
    """One block of items, ready to run over texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        import ahocorasick

        self.patterns = [Pattern(i, t, rate) for i, t in items]
        self._found: dict[str, list[tuple[int, int]]] = {}
        for number, pattern in enumerate(self.patterns):
            for piece, at in pattern.pieces:
                self._found.setdefault(piece, []).append((number, at))
        self._machine = ahocorasick.Automaton()
        for piece, where in self._found.items():
            self._machine.add_word(piece, (len(piece), where))
        if self._found:
            self._machine.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(pattern number, distance, start, end) of the best stretch of each item that is in the normalized text."""
        best: dict[int, tuple[int, int, int]] = {}
        for number, hit in self._hits(text):
            if number not in best or hit[0] < best[number][0]:
                best[number] = hit
        return [(number, *hit) for number, hit in sorted(best.items())]

    def holds(self, text: str | None) -> bool:
        """Whether the text holds any item."""
        return any(True for _ in self._hits(text))

    def _hits(self, text: str | None) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Stretches within the budget, (distance, start, end) by pattern number; none after an exact one."""
        if not text or not self._found:
            return
        plain = normalize(text)
        exact: set[int] = set()
        tried: set[tuple[int, int]] = set()
        for last, (length, where) in self._machine.iter(plain):
            for number, at in where:
                pattern = self.patterns[number]
                if number in exact:
                    continue
                begin = last + 1 - length - at
                if pattern.is_short:
                    # found whole; it counts where no word goes on at either end
                    if not _goes_on(plain, begin - 1, begin) and not _goes_on(plain, last, last + 1):
                        exact.add(number)
                        yield number, (0, begin, last + 1)
                    continue
                if plain.startswith(pattern.text, begin) if begin >= 0 else False:
                    exact.add(number)
                    yield number, (0, begin, begin + pattern.size)
                    continue
                # a stretch stands for all starts within half a budget of it, so near diagonals share one
                step = pattern.budget // 2 + 1
                if (number, begin // step) in tried:
                    continue
                tried.add((number, begin // step))
                low = max(0, begin // step * step - pattern.budget)
                high = begin // step * step + step + pattern.size + pattern.budget
                distance, end = pattern.distance(plain[low:high])
                if distance <= pattern.budget:
                    yield number, (distance, max(0, low + end - pattern.size), low + end)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> list[DataFrame]:
    """The items in parts of about ``BLOCK_CHARS`` characters at most, or one item where it is longer."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(chars / (BLOCK_CHARS // 2)))
    if count == 1:
        return [items]
    items = materialise(items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(count))), "items")
    return [items.where(F.col("block") == i).drop("block") for i in range(count)]


def _shared(items: DataFrame):  # noqa: ANN202
    """One block on all executors."""
    wanted = [(r["item_id"], normalize(r["text"])) for r in items.collect()]
    return items.sparkSession.sparkContext.broadcast([(i, t) for i, t in wanted if t])


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end) for every item that a document holds.

    Start and end are code points of the normalized text.
    """
    narrow = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, distance int, budget int, start bigint, end bigint"

    def one(items: DataFrame) -> DataFrame:
        shared = _shared(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    for number, distance, start, end in matcher.search(text.as_py()):
                        pattern = matcher.patterns[number]
                        rows.append((doc_id.as_py(), pattern.item_id, distance, pattern.budget, start, end))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return narrow.mapInArrow(run, schema)

    return reduce(DataFrame.union, [one(items) for items in _blocks(benchmark, item_col, item_text_col)])


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows whose text holds no item, whatever their ids; columns unchanged.

    Each row is judged by itself where it lies.  Several blocks of items are so many narrow maps in one pass.
    """
    at = documents.columns.index(text_col)

    def without(items: DataFrame):  # noqa: ANN202
        shared = _shared(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                clean = [not matcher.holds(text.as_py()) for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    kept = documents
    for items in _blocks(benchmark, item_col, item_text_col):
        kept = kept.mapInArrow(without(items), documents.schema)
    return kept
