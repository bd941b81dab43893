"""Content digests of values: equal digests mean that nothing has to be recomputed.

A table's digest covers, per column, every value at its place in the observed order.  For
rows that carry the place where they lie in a source, that is their place, and one aggregate
without a sort gives all columns.  For all others places are dense ranks, so rows that keep
their order keep their digest whatever ordinals they carry: the rows are sorted over ranges,
every range adds up its hashes times powers of a base, and the driver puts one short row for each
range together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.relation import Relation
from ..types import FLOAT, type_of_value

SALTS = (1, 2)
#: One odd base for each salt.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Digest:
    """``shape`` is rows and schema; ``columns`` has one entry per name; ``whole`` covers all."""

    whole: str
    shape: str = ""
    columns: tuple[tuple[str, str], ...] = ()

    def column(self, name: str) -> str:
        return dict(self.columns).get(name, "")


def _hash(*parts: object) -> str:
    return hashlib.blake2b("\x1f".join(map(repr, parts)).encode(), digest_size=16).hexdigest()


def of_scalar(value: object) -> Digest:
    """NaNs are one value, and so are both zeros; the tag counts."""
    if isinstance(value, float):
        value = "nan" if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return Digest(_hash("list", *(of_scalar(v).whole for v in value)))
    return Digest(_hash(type_of_value(value) or type(value).__name__, value))


def _cell(rel: Relation, at: str, kind: str, salt: int) -> Column:
    """The hash of a value, and of its place where it has one."""
    column = F.col(at)
    value = F.when(column == 0, F.lit(0.0)).otherwise(column) if kind == FLOAT else column
    return F.xxhash64(F.lit(salt), *(["place"] if rel.placed else ()), column.isNull(), value)


def _sums(rel: Relation) -> tuple[int, list[int]]:
    """How many rows there are, and for each column and salt the hash of all its values in order."""
    cells = [_cell(rel, f.at, f.kind, salt).alias(f"d{i}_{salt}") for i, f in enumerate(rel.fields) for salt in SALTS]
    if rel.placed:
        names = [f"d{i}_{salt}" for i in range(len(rel.fields)) for salt in SALTS]
        row = rel.df.withColumn("place", F.xxhash64(*rel.order)).select(*cells).agg(F.count(F.lit(1)).alias("rows"), *(F.bit_xor(n).alias(n) for n in names)).first()
        return row["rows"], [row[n] for n in names]
    width = len(cells)

    def add_up(batches: Iterator) -> Iterator:  # noqa: ANN401
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        rows, sums = 0, [0] * width
        for batch in batches:
            powers = []
            for base in BASES:
                steps = np.full(batch.num_rows, base, dtype=np.uint64)
                steps[:1] = pow(base, rows, 1 << 64)
                powers.append(np.cumprod(steps, dtype=np.uint64))
            for k in range(width):
                values = batch.column(k).to_numpy().view(np.uint64)
                sums[k] = (sums[k] + int((values * powers[k % 2]).sum(dtype=np.uint64))) & _MASK
            rows += batch.num_rows
        signed = [s - (1 << 64) if s >> 63 else s for s in sums]
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "rows": [rows], "sums": [signed]})

    ordered = rel.df.orderBy(*rel.order).select(*cells)
    rows, sums = 0, [0] * width
    for r in sorted(ordered.mapInArrow(add_up, "part bigint, rows bigint, sums array<bigint>").collect()):
        shift = [pow(base, rows, 1 << 64) for base in BASES]
        sums = [(s + shift[k % 2] * (x & _MASK)) & _MASK for k, (s, x) in enumerate(zip(sums, r["sums"], strict=True))]
        rows += r["rows"]
    return rows, sums


def of_relation(rel: Relation) -> Digest:
    """The digest of a table; the caller caches ``rel.df`` where it is used again."""
    if not rel.fields:
        rows = rel.df.count()
        return Digest(_hash("table", rows), _hash("shape", rows, ()))
    rows, sums = _sums(rel)
    shape = _hash("shape", rows, tuple(rel.schema))
    columns = tuple((f.name, _hash(f.name, f.kind, rows, *sums[2 * i : 2 * i + 2])) for i, f in enumerate(rel.fields))
    return Digest(_hash("table", rows, columns), shape, columns)


def of_value(value: object) -> Digest:
    return of_relation(value) if isinstance(value, Relation) else of_scalar(value)
