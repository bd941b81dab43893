"""Best-fit packing after Martello-Toth dominance reduction, over a histogram of lengths.

Documents are tokenized, cut into pieces of at most ``size`` tokens only where they are
longer, and packed into as few sequences of ``size`` tokens as can be found.  Pieces of
one length are alike, so the driver packs a histogram: at most ``size`` counts, whatever
the corpus.  Its plan is a list of patterns (the lengths of one sequence, and how many
sequences look like that):

* dominance reduction: for every piece, longest first, a sequence of it alone, with one
  or with two others is fixed where that dominates all other ways to fill it, so some best
  packing has it; the instance shrinks until no piece gives one;
* best fit decreasing packs the remainder: longest first, into the fullest open
  sequences that still have room.

The sequences then take pieces by rank: the k-th piece of a length goes to that
length's k-th place.  Ranks come from counts per task and length, summed by Spark, so
neither one task nor the driver ever sees all pieces.

Null and empty texts are documents of the end id alone.  Rows that repeat a doc_id are
packed as documents of their own.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder

SIZE = 2048
END_ID = 0
Pattern = tuple[tuple[int, ...], int]


class _Pieces:
    """A histogram of lengths from which sequences are taken."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.count = {n: c for n, c in lengths.items() if c > 0}
        self.order = sorted(self.count)

    def take(self, pattern: tuple[int, ...]) -> int:
        """Take out as many sequences like ``pattern`` as there are pieces for."""
        need = Counter(pattern)
        times = min(self.count.get(n, 0) // k for n, k in need.items())
        for n, k in need.items():
            self.count[n] -= k * times
            if not self.count[n]:
                del self.count[n]
                self.order.pop(bisect_left(self.order, n))
        return times

    def smallest(self, how_many: int, aside: int, above: int = 0, below: int | None = None) -> list[int]:
        """The smallest pieces besides one of length ``aside``, between two lengths (both excluded)."""
        out: list[int] = []
        for at in range(bisect_right(self.order, above), len(self.order)):
            n = self.order[at]
            if below is not None and n >= below:
                break
            out += [n] * min(how_many, self.count[n] - (n == aside))
            if len(out) >= how_many:
                break
        return out[:how_many]

    def largest(self, room: int, aside: int) -> int | None:
        """The largest piece that fits, besides one of length ``aside``."""
        at = bisect_right(self.order, room) - 1
        if at >= 0 and self.order[at] == aside and self.count[aside] == 1:
            at -= 1
        return self.order[at] if at >= 0 else None

    def fullest_pair(self, room: int, aside: int) -> tuple[int, int] | None:
        """The two pieces (larger first) that leave least of the room, besides one of length ``aside``."""
        best, low = None, 0
        for high in range(bisect_right(self.order, room) - 1, -1, -1):
            a = self.order[high]
            if self.count[a] - (a == aside) < 1:
                continue
            while low < len(self.order) and self.order[low] + a <= room:
                low += 1
            # the largest partner not above a: another piece is wanted where both are of one length
            at = min(low - 1, high)
            while at >= 0:
                b = self.order[at]
                if self.count[b] - (b == aside) - (b == a) >= 1:
                    if best is None or a + b > sum(best):
                        best = (a, b)
                    break
                at -= 1
            if best and 2 * a <= sum(best):
                break  # smaller first pieces cannot do better
        return best


def _dominating(left: _Pieces, n: int, size: int) -> tuple[int, ...] | None:
    """A sequence with a piece of length ``n`` that no packing needs to do without, if one can be told.

    What may lie beside the piece is at most one piece, two, or more, which the smallest
    pieces tell.  One partner: the largest that fits replaces any other.  An exact fill
    replaces whatever else.  Two at most: the largest single partner does where it is as
    long as the fullest pair; the fullest pair does where its larger piece is the largest
    partner and no two pieces between its own lengths fit, for then its pieces replace
    those of any other pair one by one.
    """
    room = size - n
    partner = left.largest(room, n)
    if partner is None:
        return (n,)
    few = left.smallest(3, n)
    if partner == room or len(few) < 2 or few[0] + few[1] > room:
        return (n, partner)
    if len(few) == 3 and sum(few) <= room:
        return None
    pair = left.fullest_pair(room, n)
    if partner >= sum(pair):
        return (n, partner)
    between = left.smallest(2, n, pair[1], pair[0])
    if partner == pair[0] and (len(between) < 2 or sum(between) > room):
        return (n, *pair)
    return None


def reduce_dominated(lengths: dict[int, int], size: int = SIZE) -> tuple[list[Pattern], dict[int, int]]:
    """The sequences that can be fixed for good, and the counts that remain.

    Every length is tried, longest first, and all of them again as long as something was
    fixed.  A decision holds for all equal pieces at once: as others are taken, less fits
    beside the next, and the sequence that was chosen still does.
    """
    left = _Pieces(lengths)
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for n in reversed(list(left.order)):
            while n in left.count and (pattern := _dominating(left, n, size)):
                fixed.append((pattern, left.take(pattern)))
                again = True
    return fixed, left.count


def best_fit(lengths: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Best fit decreasing over a histogram; equal open sequences move together."""
    rooms: list[int] = []  # distinct rooms of open sequences, ascending
    open_at: dict[int, list[list]] = {}  # room -> [pattern, how many]

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if room not in open_at:
            insort(rooms, room)
            open_at[room] = []
        open_at[room].append([pattern, times])

    for n in sorted(lengths, reverse=True):
        count = lengths[n]
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                fit = size // n
                whole, rest = divmod(count, fit)
                if whole:
                    put((n,) * fit, whole, size - fit * n)
                if rest:
                    put((n,) * rest, 1, size - rest * n)
                break
            room = rooms[at]
            group = open_at[room]
            pattern, times = group.pop()
            if not group:
                del open_at[room]
                rooms.pop(at)
            fit = room // n  # the fullest sequence stays the best one until it has no room
            whole = min(times, count // fit)
            if whole:
                put((*pattern, *(n,) * fit), whole, room - fit * n)
                count -= whole * fit
            if whole < times:
                over = times - whole
                if count and count < fit:
                    put((*pattern, *(n,) * count), 1, room - count * n)
                    over, count = over - 1, 0
                if over:
                    put(pattern, over, room)
    return [(tuple(p), t) for groups in open_at.values() for p, t in groups]


def plan(lengths: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that hold every piece exactly once."""
    fixed, left = reduce_dominated(lengths, size)
    return fixed + best_fit(left, size)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length its places: (length, first rank, first sequence, offset), by length and rank.

    A row stands for as many ranks as its pattern has sequences, one place in each.
    """
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, times, sequence, offset))
            offset += n
        sequence += times
    rows.sort(key=lambda r: r[0])
    out, rank, last = [], 0, None
    for n, times, first, offset in rows:
        rank = rank if n == last else 0
        out.append((n, rank, first, offset))
        rank, last = rank + times, n
    table = np.array(out, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces(
    df: DataFrame, vocabulary: str, keeps_space: bool, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE
) -> DataFrame:
    """(doc_id, piece, start, length, tokens, task, nth), written down once.

    ``task`` numbers the task that made a piece and ``nth`` its place among that task's
    pieces of its length, so both must not be made twice.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, end = encoder(vocabulary, keeps_space), np.array([END_ID], dtype="<u4").tobytes()
        seen: Counter[int] = Counter()
        names = ["doc_id", "piece", "start", "length", "tokens", "task", "nth"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for block in (b for batch in batches for b in encode.encode_rows(batch)):
            rows: list[tuple] = []
            for doc_id, ids in block:
                whole = ids + end
                for piece, at in enumerate(range(0, len(whole), 4 * size)):
                    part = whole[at : at + 4 * size]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, part, task, seen[n]))
                    seen[n] += 1
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, tokens binary, task bigint, nth bigint"
    return materialise(narrow.mapInArrow(cut, schema), "pieces")


def pack(
    df: DataFrame, vocabulary: str, keeps_space: bool, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE
) -> DataFrame:
    """(doc_id, piece, start, length, tokens, sequence_id, offset) of every piece."""
    spark = df.sparkSession
    cut = pieces(df, vocabulary, keeps_space, id_col, text_col, size)
    # One row per task and length; a window over one length holds one short row per task.
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places_of = spark.sparkContext.broadcast(places(plan(histogram, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places_of.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            # the last row of this length whose first rank is not above ours
            top = np.int64(1) << 40
            row = np.searchsorted(table["length"] * top + table["rank"], length * top + rank, side="right") - 1
            sequence = table["sequence"][row] + rank - table["rank"][row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][row])],
                names=["doc_id", "piece", "start", "length", "tokens", "sequence_id", "offset"],
            )

    before = ranks.select("task", "length", "before")  # one short row per task and length
    ranked = cut.join(before, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "tokens", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, tokens binary, sequence_id bigint, offset bigint"
    )
