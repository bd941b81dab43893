"""N-gram Jaccard join by PartEnum signatures, exact at every size.

A document is the set of its distinct word shingles, as 64-bit hashes.  Two documents
link when ``100 * |A & B| >= percent * |A | B|``.  The join runs in these steps:

1. Documents with equal sets form one class, represented by its smallest id (a partial
   aggregate, so a class with a third of all rows is no hot spot).
2. Every set emits PartEnum signatures (a task's repeated sets once).  Sizes are divided into bands; linked sets
   lie in one band or in neighbours, and then differ in at most ``k`` elements.  Each
   band hashes the shingle domain into ``n1 = ceil((k + 1) / 2)`` parts, so some part
   differs in at most one element, and every part into three sub-parts, of which two
   are enumerated at a time: linked sets share a signature for certain.
3. A bucket is the set of documents under one signature.  Buckets with the same members
   count once.  Every member is compared with its bucket's smallest document only, and,
   where the links found leave the bucket in several components, with its largest.
4. Buckets that are still open are compared in blocks of bounded size.  Sketches bound
   the distance of two sets from below, and a block hands on its members that may link
   with one of another component by that bound.  Their sets then meet in the same blocks,
   where every such pair is verified, and a block gives the links that join components.

Joins by signature deal a signature that many documents share over several keys.
So no step emits the pairs of a group (a pair of blocks gives no more rows than it has members),
and none loses a link that would join two components.  Signatures without elements are not emitted: bands with small parts have
spare parts, of which linked sets agree in as many more, and a set with more empty
selections than that falls back, in addition, to a second, third and fourth partitioning,
as does every set that agrees with it only in empty ones.

An empty or null text has no shingles and links with nothing; a null id links with
nothing and has a null component.  An id names one text; rows that repeat both count as
one document, and each row is returned.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, temporary
from .components import connected_components

BAND_GROWTH = 1.3
SUB_PARTS = 3
SEEDS = 4
#: Signatures are matched one slice of their range after the other, which divides the shuffled bytes on disk.
SLICES = 4
#: Bytes of sets that one block of the exact comparison may hold, and documents.
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 1024
CELLS_PER_EDIT = 8
#: Rows of one signature that a join keeps together; more are dealt over so many more keys.
HOT_ROWS = 500
#: Nearest partners of a member that a block verifies at first, and how many times more while some are still apart from it.
NEAREST, NEAREST_GROWTH = 4, 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    short = min(width, len(words))
    total = np.full(len(words) - short + 1, np.uint64(short), dtype=np.uint64)
    for i in range(short):
        total = _mix(total * _ODD[:1] + hashed[i : len(hashed) - short + 1 + i])
    return np.unique(total)


class Scheme:
    """Bands, distances and signatures for one threshold."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent must lie between 50 and 100")
        self.percent = percent
        growth = max(BAND_GROWTH, 100 / percent + 0.05)
        self._starts = [1]
        while self._starts[-1] < 1 << 40:
            self._starts.append(int(self._starts[-1] * growth) + 1)

    def distance(self, sizes: int) -> int:
        """Elements in which linked sets of that total size differ at most."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    @lru_cache(maxsize=4096)  # noqa: B019 - one scheme per worker
    def instances(self, size: int) -> tuple[tuple[int, int, int], ...]:
        """(band, parts, spare) that a set of this size takes part in.

        With more parts than the distance needs, ``spare`` of them may go without a signature.
        """
        import bisect

        band = bisect.bisect_right(self._starts, size) - 1
        out = []
        for b in (band - 1, band):
            if b < 0:
                continue
            top = self._starts[b + 1] - 1
            reach = top * 100 // self.percent
            if size > reach:
                continue
            k = self.distance(top + reach)
            if k:
                least = -(-(k + 1) // 2)
                few = SUB_PARTS * math.exp(-(SUB_PARTS - 1) / SUB_PARTS * self._starts[b] / least)  # parts with an empty selection
                spare = math.ceil(2 * few * least) if least >= 8 and few > 0.002 else 0
                out.append((b, least + spare, spare))
        return tuple(out)

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """All signatures of a set, those of empty selections only where every seed has too many of them.

        Linked sets agree in a selection of at least one part more than are spare.  If at most
        ``spare`` parts have an empty selection, one that they agree in is not empty.
        """
        found = []
        for band, parts, spare in self.instances(len(hashes)):
            for seed in range(SEEDS):
                scrambled = _mix(hashes + _ODD[seed : seed + 1] * np.uint64(band + 1))
                cell = (scrambled % np.uint64(parts * SUB_PARTS)).astype(np.int64)
                value = _mix(scrambled + _ODD[1:2])
                low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), parts * SUB_PARTS)
                high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), parts * SUB_PARTS)
                sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
                sums = sums.reshape(parts, SUB_PARTS)
                count = np.bincount(cell, minlength=parts * SUB_PARTS).reshape(parts, SUB_PARTS)
                chosen = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums
                filled = (count.sum(axis=1, keepdims=True) - count) > 0
                place = np.arange(parts * SUB_PARTS, dtype=np.uint64).reshape(parts, SUB_PARTS)
                name = np.uint64((band * SEEDS + seed) << 40) + place
                signature = _mix(chosen + _mix(name + _ODD[2:3]))
                last = seed == SEEDS - 1
                found.append(signature.reshape(-1) if last else signature[filled])
                if last or np.count_nonzero(~filled.all(axis=1)) <= spare:
                    break
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def sketch(hashes: np.ndarray, cells: int) -> np.ndarray:
    """One bit per cell of the domain: whether it holds an odd number of elements.

    Sets differ in at least as many elements as bits of their sketches.  The exclusive or
    of the two halves of a sketch is the sketch of half as many cells.
    """
    cell = ((hashes >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8))


def sketch_cells(distance: int) -> int:
    """Cells that tell sets apart which differ a little more than linked sets may; a power of two."""
    return 1 << max(8, (CELLS_PER_EDIT * max(1, distance) - 1).bit_length())


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def signed(df: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sigs, sketch): size, 128-bit key, signatures and sketch of each set; an empty set has no key.

    Of equal sets that one task meets, only the first gets signatures and a sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, met = Scheme(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, k1, k2, sigs, sketches = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = shingle_hashes(text.as_py(), width)
                    digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                    sizes.append(len(found))
                    k1.append(digest and int.from_bytes(digest[:8], "little", signed=True))
                    k2.append(digest and int.from_bytes(digest[8:], "little", signed=True))
                    fresh = digest is not None and doc_id is not None and digest not in met
                    sigs.append(scheme.signatures(found).view(np.int64) if fresh else np.empty(0, np.int64))
                    sketches.append(sketch(found, sketch_cells(scheme.distance(2 * len(found)))).tobytes() if fresh else None)
                    if fresh:
                        met.add(digest)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs)))
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in (sizes, k1, k2)), lists, pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "k1", "k2", "sigs", "sketch"])

    return df.mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sigs array<bigint>, sketch binary")


def _by_signature(rows: DataFrame, each: DataFrame) -> DataFrame:
    """``rows`` (with sig and doc) joined by signature to ``each``, a written table of one row per signature and its count ``n``.

    A signature with many rows is dealt by document over several keys, of about ``HOT_ROWS`` rows.
    """
    hot = each.where(F.col("n") > HOT_ROWS).select("sig", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("keys"))
    dealt = rows.join(materialise(hot, "hot"), "sig", "left").withColumn("key", F.pmod(F.xxhash64("doc"), F.coalesce("keys", F.lit(1))).cast("int"))
    known = each.withColumn("key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / HOT_ROWS).cast("int") - 1)))
    return dealt.drop("keys").join(known.drop("n"), ["sig", "key"]).drop("key")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """(doc, items): the sorted hashes of each set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc", "items"])

    return df.mapInArrow(run, "doc bigint, items binary")


def _may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, leaf) that their sketches do not rule out."""
    joined = pairs.join(sketches.toDF("leaf", "nv", "sv"), "leaf").join(sketches.toDF("hub", "nu", "su"), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            good = []
            for nu, a, nv, b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True):
                both = [np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b)]
                n, side = np.array([nu, nv]), np.array([0, 1])
                good.append(any(True for _ in _near(scheme, n, side, side, both)))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return joined.select("hub", "leaf", "nu", "su", "nv", "sv").mapInArrow(run, "hub bigint, leaf bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (hub, leaf) that link; the set of a hub, which many pairs may share, is met last and not dealt out again."""
    joined = pairs.join(sets.toDF("leaf", "b"), "leaf").join(sets.toDF("hub", "a"), "hub").select("hub", "leaf", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            good = [
                scheme.links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                for x, y in zip(a, b, strict=True)
            ]
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["u", "v"])

    return joined.mapInArrow(run, "u bigint, v bigint")


def _near(scheme: Scheme, n: np.ndarray, comps: np.ndarray, side: np.ndarray, sketches: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member its partners in another component that the sketches cannot rule out, and in how many bits they differ.

    Members of side 0 meet those of side 1; where only one side is given, each meets the later ones.
    """
    size = min(len(x) for x in sketches)
    folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in sketches])
    both = bool((side == 0).any() and (side == 1).any())
    for i in np.flatnonzero(side == 0) if both else range(len(n)):
        other = np.flatnonzero(side == 1) if both else np.arange(i + 1, len(n))
        other = other[comps[other] != comps[i]]
        most = (100 - scheme.percent) * (n[other] + n[i]) // (100 + scheme.percent)
        other, most = (x[np.abs(n[other] - n[i]) <= most] for x in (other, most))
        differ = np.bitwise_count(folded[other] ^ folded[i]).sum(axis=1, dtype=np.int64)
        if (close := differ <= most).any():
            yield i, other[close], differ[close]


def _near_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Members (sig, i, j, side, doc, comp) of blocks, of buckets (sig, doc, comp), that may link with one of another component there.

    A bucket is cut into blocks of bounded size and every pair of blocks (i, j) is compared by
    sketches, a lower bound of the distance, so no linked pair is missed.
    """
    sized = members.join(sketches.select("doc", (F.col("n") * 8).alias("bytes")), "doc")
    size = sized.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(BLOCK_DOCS), F.col("bytes") / F.lit(BLOCK_BYTES)))
    size = materialise(size.select("sig", "n", blocks.cast("int").alias("blocks")), "sizes")
    # Block pair (i, j), i <= j, gets block i as side 0 and block j as side 1 (a block with itself: side 0 only).
    own = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(
            F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"),
            F.when(F.col("own") <= o, 0).otherwise(1).alias("side"),
        ),
    )
    spread = (
        _by_signature(members, size).withColumn("own", own).withColumn("pair", F.explode(pairs))
        .join(sketches, "doc").select("sig", "pair.i", "pair.j", "pair.side", "doc", "comp", "n", "sketch")
    )

    def run(table: pa.Table) -> pa.Table:
        comps, side, n = (table.column(c).to_numpy() for c in ("comp", "side", "n"))
        held = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sketch")]
        near = np.zeros(len(n), dtype=bool)
        for i, other, _ in _near(Scheme(percent), n, comps, side, held):
            near[i] = near[other] = True
        return table.select(["sig", "i", "j", "side", "doc", "comp"]).filter(pa.array(near))

    return spread.groupBy("sig", "i", "j").applyInArrow(run, "sig bigint, i int, j int, side int, doc bigint, comp bigint")


def _joining(scheme: Scheme, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join different components of the members, by place; ``comps`` is changed to the components that they make.

    Every pair that sketches cannot rule out is verified, the nearest ones of a member first, unless its components were joined before.
    """
    n = np.array([len(x) for x in sets])
    drawn = [sketch(x, sketch_cells(scheme.distance(2 * len(x)))) for x in sets]
    places = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(n)[:-1])
    own = np.zeros(1 + max(int(x.max()) for x in places), dtype=bool)
    for i, other, differ in _near(scheme, n, comps, side, drawn):
        other, take = other[np.argsort(differ, kind="stable")], NEAREST
        own[places[i]] = True
        while len(other):
            now, other = other[:take], other[take:]
            begin = np.cumsum(n[now]) - n[now]
            common = np.add.reduceat(own[np.concatenate([places[o] for o in now])], begin, dtype=np.int64)
            for o in now[100 * common >= scheme.percent * (n[now] + n[i] - common)]:
                if comps[o] != comps[i]:
                    yield i, int(o)
                    comps[comps == comps[o]] = comps[i]
            other, take = other[comps[other] != comps[i]], take * NEAREST_GROWTH
        own[places[i]] = False


def _block_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of links that join components, fewer than members in each pair of blocks (sig, i, j)."""

    def run(table: pa.Table) -> pa.Table:
        docs, side, comps = table.column("doc").to_numpy(), table.column("side").to_numpy(), np.array(table.column("comp").to_numpy())
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        found = np.array(list(_joining(Scheme(percent), comps, side, held)), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": docs[found[:, 0]], "v": docs[found[:, 1]]})

    joined = near.join(sets, "doc").select("sig", "i", "j", "side", "doc", "comp", "items")
    return joined.groupBy("sig", "i", "j").applyInArrow(run, "u bigint, v bigint")


def _buckets(signatures: DataFrame, copies: DataFrame) -> DataFrame:
    """(sig, doc) of the buckets with two classes or more, one bucket for each set of members.

    ``copies`` gives the representative of documents that are none themselves.
    """
    parts = []
    for number in range(SLICES):
        part = signatures.where(F.pmod("sig", F.lit(SLICES)) == number)
        shared = materialise(part.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
        rows = _by_signature(part, shared).join(copies, "doc", "left")
        parts.append(materialise(rows.select("sig", F.coalesce("rep", "doc").alias("doc")).distinct(), "shared"))
    rows = reduce(DataFrame.union, parts)
    marks = [F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    grouped = rows.groupBy("sig").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"), *marks)
    kept = grouped.where("low < high").groupBy("low", "high", "n", "x1", "x2").agg(F.min("sig").alias("sig"))
    return _by_signature(rows, materialise(kept.select("sig", "n"), "buckets")).select("sig", "doc")


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per input row."""
    with temporary(df.sparkSession) as keep:
        return keep(materialise(_components(_narrow(df, id_col, text_col), width, percent), "components"))


def _components(documents: DataFrame, width: int, percent: int) -> DataFrame:
    made = materialise(signed(documents, width, percent), "signed")
    keys = materialise(made.select("doc_id", "n_shingles", "k1", "k2"), "keys")
    known = keys.where("doc_id IS NOT NULL AND k1 IS NOT NULL")
    classes = materialise(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    copies = known.join(classes.where("n > 1"), ["k1", "k2"]).where("doc_id <> rep")
    copies = materialise(copies.select(F.col("doc_id").alias("doc"), "rep").distinct(), "copies")
    signatures = made.select(F.explode("sigs").alias("sig"), F.col("doc_id").alias("doc"))
    members = materialise(_buckets(signatures, copies), "members")
    named = documents.where("doc_id IS NOT NULL")

    def of_ids(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        wanted = materialise(ids.select(F.col("doc").alias(column)).distinct(), "wanted")
        return rows.join(wanted, column, "left_semi")

    drawn = made.where("sketch IS NOT NULL").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch")
    drawn = drawn.join(copies, "doc", "left").select(F.coalesce("rep", "doc").alias("doc"), "n", "sketch")
    sketches = materialise(of_ids(drawn, "doc", members).dropDuplicates(["doc"]), "sketches")
    discard(made)

    links: DataFrame | None = None
    found, residual, labelled = None, members.withColumn("comp", F.col("doc")), members

    def follow(more: DataFrame) -> None:
        """The components by all links so far."""
        nonlocal links, found
        links = more if links is None else links.union(more)
        if found is None or not more.isEmpty():
            found = materialise(connected_components(links), "components")

    def settle(pairs: DataFrame) -> None:
        """Verify pairs, follow all links so far, and keep the buckets that lie in several components."""
        nonlocal residual
        ends = pairs.select(F.explode(F.array("hub", "leaf")).alias("doc"))
        sets = materialise(_sets(of_ids(named, "doc_id", ends), width), "sets")
        more = materialise(_verified(pairs, sets.dropDuplicates(["doc"]), percent), "links", 200)
        discard(sets)
        follow(more)
        labelled = residual.select("sig", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
            "sig", "doc", F.coalesce("component", "doc").alias("comp")
        )
        several = labelled.groupBy("sig").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("n"))
        several = materialise(several.where("a < b").select("sig", "n"), "open")
        residual = materialise(_by_signature(labelled, several), "residual")

    def sliced(rows: DataFrame) -> list[DataFrame]:
        return [rows.where(F.pmod(F.xxhash64("sig"), F.lit(SLICES)) == i) for i in range(SLICES)]

    # Two rounds of stars around the smallest and then the largest document of each open bucket, then everything left.
    for leader in (F.min, F.max):
        lead = residual.groupBy("sig").agg(leader(F.struct("doc", "comp")).alias("lead"), F.count(F.lit(1)).alias("n"))
        stars = _by_signature(residual, materialise(lead, "leaders")).where(F.col("comp") != F.col("lead.comp"))
        stars = stars.select(F.col("lead.doc").alias("hub"), F.col("doc").alias("leaf")).distinct()
        settle(materialise(_may_link(stars, sketches, percent), "pairs"))
        if residual.isEmpty():
            break
    else:
        near = reduce(DataFrame.union, [materialise(_near_members(x, sketches, percent), "near") for x in sliced(residual)])
        sets = materialise(_sets(of_ids(named, "doc_id", near), width).dropDuplicates(["doc"]), "sets")
        follow(reduce(DataFrame.union, [materialise(_block_links(x, sets, percent), "links", 200) for x in sliced(near)]))
        discard(sets)

    with_rep = keys.join(classes.drop("n"), ["k1", "k2"], "left")
    placed = with_rep.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row of each component, that of the smallest id; columns unchanged.

    Rows without words link with nothing and all stay.  Rows are told apart by their ids or,
    where an id is null or repeats, by numbers that are written down with the rows.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    if not ids.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
        rows = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
        found = jaccard_components(rows, "__row", text_col, width, percent).join(
            rows.select(F.col("__row").alias("doc_id"), F.col(id_col).cast("long").alias("id")), "doc_id"
        )
        first = F.struct(F.col("id").isNull().alias("unnamed"), "id", F.col("doc_id").alias("row"))
        kept = found.groupBy("component_id").agg(F.min(first).alias("first")).select(F.col("first.row").alias("__row"))
        return rows.join(materialise(kept, "kept"), "__row", "left_semi").select(*df.columns)
    losers = (
        jaccard_components(df, id_col, text_col, width, percent)
        .where("component_id < doc_id").select(F.col("doc_id").alias("__loser"))
    )
    losers = materialise(losers, "losers")
    return df.join(losers, F.col(id_col) == F.col("__loser"), "left_anti")
