"""Language-model scoring by cross-entropy difference between matched n-gram models.

Target and background are interpolated word-pair models over one vocabulary, the distinct
words of all documents and one unit that closes a text (and stands before the next).  The
probability of a unit is that of the pair with the unit before it, smoothed towards that
of the unit alone, smoothed towards an even share of the vocabulary.

The target model counts the documents that are labelled good, the background model counts
every document.  Two things match them.  The background's counts are scaled to the
target's total, so they are what a random part of the corpus as large as the target is
expected to hold, and smoothing weighs alike in both; no document is left out for that.
And no model that scores a document has seen it: its own counts are taken away first,
from the background and, where it is one of them, from the target.

A document's loss is that of all its units, in nats a unit (``n_tokens``: its words and
the closing unit); its score is the loss under the target model minus that under the
background model: the lower, the closer to the target.

What is counted grows with the corpus, so it is never gathered in one place.  Each batch of
documents sends its distinct words and pairs, by 64-bit hash, to the parts of the count
table; a part adds them up over all batches and answers each batch in the order in which
it asked.  Only three totals reach the driver.  Null and empty texts have no tokens and a score of
0.  An empty target, or one that holds every document, makes both models equal.  Rows that repeat an id are
counted and scored each for itself; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, discard_part, materialise

#: Weight of the lower order in each interpolation, as a count.
UNIT_PRIOR, PAIR_PRIOR = 8.0, 8.0
#: Bytes of text in a batch, and about so many for each part of the count table.
BATCH_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: The parts are added up in so many turns, which divides the shuffled bytes on disk.
SLICES = 4

# Keys have 56 bits; those of words are odd and all others even.
KEY_BITS = 56
_CLOSE, _ALL = np.uint64(0xE8FEB86659FD93), np.uint64(0x27599BF4325C36)
_CUT, _ONE, _EVEN = np.uint64(64 - KEY_BITS), np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFE)
_STEP, _M1, _M2 = (np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values, and the distinct values by code."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class Units:
    """The units of some texts, as places among the distinct ``keys`` under which the count table knows them.

    ``words`` are the keys of the distinct words, ``code`` says for every unit which of them
    it is, one more standing for the closing unit, and ``n`` how many units a text has.
    All the rest follows from these three.
    """

    def __init__(self, words: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        self.words, self.code, self.n = words, code, n
        close = len(words)
        pair, pairs = _coded(pa.array(np.roll(code, 1) * (close + 1) + code))  # every text follows a closing unit
        one = np.append(words, _CLOSE)
        first, second = np.divmod(pairs.to_numpy(), close + 1)
        keys = np.concatenate([one, [_ALL], (_mixed(_mixed(one[first] + _STEP) + one[second]) >> _CUT) & _EVEN])
        order = np.argsort(keys)
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.one, self.pair = place[code], place[close + 2 + pair]
        self.close, self.all = int(place[close]), int(place[close + 1])

    @classmethod
    def of_texts(cls, texts: pa.Array) -> Units:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        real = pc.greater(pc.binary_length(words), 0)
        found, distinct = _coded(words.filter(real))
        owner = owner[real.to_numpy(zero_copy_only=False)]
        count = np.bincount(owner, minlength=len(texts))
        filled = count > 0
        code = np.full(len(found) + int(filled.sum()), len(distinct), dtype=np.int64)
        code[np.arange(len(found)) + (np.cumsum(filled) - 1)[owner]] = found  # the place behind each text's words stays
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct), dtype=np.uint64, count=len(distinct))
        return cls((hashes >> _CUT) | _ONE, code, count + filled)

    def parts(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the count table that know the keys, and where each one's keys begin; parts are ranges of keys."""
        part = ((self.keys >> np.uint64(KEY_BITS - 32)) * np.uint64(count)) >> np.uint64(32)
        return np.unique(part, return_index=True)

    def counts(self, good: np.ndarray) -> list[np.ndarray]:
        """How often each key occurs, and how often in the texts that are ``good``."""
        out, is_good = [], np.repeat(good, self.n)
        for one, pair in ((self.one, self.pair), (self.one[is_good], self.pair[is_good])):
            n = np.bincount(one, minlength=len(self.keys)) + np.bincount(pair, minlength=len(self.keys))
            n[self.all] = len(one)
            out.append(n)
        return out


def _own(place: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """How often each unit's place occurs in its document."""
    code, _ = _coded(pa.array(doc * span + place))
    return np.bincount(code)[code] if len(code) else code


def mean_losses(
    units: Units, good: np.ndarray, counts: np.ndarray, good_counts: np.ndarray, vocabulary: int
) -> tuple[np.ndarray, np.ndarray]:
    """The mean loss of each document under the target and the background model; 0 for one without units.

    The counts are those of the units' keys over all documents and over those that are ``good``.
    """
    one, pair, n, of_all = units.one, units.pair, units.n, units.all
    scale = float(good_counts[of_all]) / max(1, int(counts[of_all]))
    doc = np.repeat(np.arange(len(n)), n)
    starts = (np.cumsum(n) - n)[n > 0]
    before = np.roll(one, 1)
    before[starts] = units.close
    own_one, own_pair = _own(one, doc, len(counts)), _own(pair, doc, len(counts))
    own_before = np.roll(own_one, 1)
    own_before[starts] = 1
    out = []
    for total, seen, weight in ((good_counts, good.astype(float), 1.0), (counts, np.ones(len(n)), scale)):
        mine = seen[doc]
        alone = weight * (total[one] - mine * own_one) + UNIT_PRIOR / vocabulary
        alone /= weight * (total[of_all] - mine * n[doc]) + UNIT_PRIOR
        both = weight * (total[pair] - mine * own_pair) + PAIR_PRIOR * alone
        both /= weight * (total[before] - mine * own_before) + PAIR_PRIOR
        mean = np.zeros(len(n))
        if len(starts):
            mean[n > 0] = -np.add.reduceat(np.log(both), starts) / n[n > 0]
        out.append(mean)
    return out[0], out[1]


def _packed(values: np.ndarray, kind: str) -> bytes:
    raw = values.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), dtype=kind)


def _packed_planes(values: np.ndarray) -> bytes:
    """Numbers as their byte planes, of which the upper ones are nearly empty."""
    return _packed(values.view(np.uint8).reshape(-1, values.itemsize).T, "u1")


def _unpacked_planes(raw: bytes, kind: str) -> np.ndarray:
    planes = _unpacked(raw, "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their steps."""
    return _packed_planes(np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8"))


def _unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked_planes(raw, "<u8"), dtype=np.uint64).view(np.int64)


GATHERED = pa.schema([
    ("slice", pa.int32()), ("batch", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("good", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("targets", pa.list_(pa.bool_())), ("words", pa.binary()),
    ("code", pa.binary()),
])
_GATHERED_SQL = (
    "slice int, batch bigint, part bigint, keys binary, n binary, good binary, ids array<bigint>, sizes array<bigint>, "
    "targets array<boolean>, words binary, code binary"
)


def _gathered(flagged: DataFrame, parts: int) -> DataFrame:
    """For each batch one row of its documents (slice -1), and one of what it asks of each part of the count table."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, texts, good = (table.column(i).combine_chunks() for i in range(3))
        flags = good.to_numpy(zero_copy_only=False).astype(bool)
        units = Units.of_texts(texts)
        number = uuid.uuid4().int >> 65
        docs = {
            "slice": -1, "batch": number, "ids": ids.to_pylist(), "sizes": units.n.tolist(), "targets": flags.tolist(),
            "words": _packed_planes(units.words.astype("<u8")), "code": _packed_planes(units.code.astype("<i4")),
        }
        yield pa.RecordBatch.from_pylist([docs], schema=GATHERED)
        known, bounds = units.parts(parts)
        split = [np.split(x, bounds[1:]) for x in (units.keys, *units.counts(flags))]
        asked = [
            {"slice": int(part) % SLICES, "batch": number, "part": int(part), "keys": _packed_keys(k), "n": _packed(n, "<i8"), "good": _packed(g, "<i8")}
            for part, k, n, g in zip(known, *split, strict=True)
        ]
        for at in range(0, len(asked), 1000):
            yield pa.RecordBatch.from_pylist(asked[at : at + 1000], schema=GATHERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            begin = 0
            for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                size += length + 16
                if size >= BATCH_BYTES:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield from rows(held)
                    held, size, begin = [], 0, i + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield from rows(held)

    return flagged.select("doc_id", "text", "is_good").mapInArrow(run, _GATHERED_SQL)


def _added(asked: DataFrame) -> DataFrame:
    """(batch, part, n, good, words): sums over all batches, in the order of the keys that a batch asked for.

    ``words`` is how many distinct words a part knows, said once.
    """

    def run(table: pa.Table) -> pa.Table:
        raw = [_unpacked_keys(x.as_py()) for x in table.column("keys")]
        bounds = np.cumsum([len(x) for x in raw])[:-1]
        place, keys = _coded(pa.array(np.concatenate(raw)))
        sums = {}
        for name in ("n", "good"):
            values = np.concatenate([_unpacked(x.as_py(), "<i8") for x in table.column(name)])
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, place, values)
            sums[name] = pa.array([_packed(x, "<i8") for x in np.split(total[place], bounds)], pa.binary())
        words = np.zeros(table.num_rows, dtype=np.int64)
        words[0] = np.count_nonzero(keys.to_numpy() & 1)
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), **sums, "words": words})

    narrow = asked.select("batch", "part", "keys", "n", "good")
    return narrow.groupBy("part").applyInArrow(run, "batch bigint, part bigint, n binary, good binary, words bigint")


def score(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) per input row.

    ``target`` has one column, the ids of the target documents.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = target.select(F.col(target.columns[0]).cast("long").alias("doc_id")).distinct().withColumn("is_good", F.lit(True))
    # texts meet their labels by one sort-merge join at every size
    flagged = narrow.join(good.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("is_good", F.lit(False)).alias("is_good"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gathered = materialise(_gathered(flagged, 1 + size // PART_BYTES), "units", by="slice")
    documents = gathered.where("slice = -1")
    answers = []
    for number in range(SLICES):
        answers.append(materialise(_added(gathered.where(F.col("slice") == number)), "ngrams", rows_at_once=100))
        discard_part(gathered, f"slice={number}")
    sums = reduce(DataFrame.union, answers)
    vocabulary = max(1, sums.agg(F.sum("words")).first()[0] or 0)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("part")
        n, g = (np.concatenate([_unpacked(x.as_py(), "<i8") for x in found.column(c)]) for c in ("n", "good"))
        row = docs.slice(0, 1).to_pylist()[0]
        sizes = np.array(row["sizes"], dtype=np.int64)
        units = Units(_unpacked_planes(row["words"], "<u8"), _unpacked_planes(row["code"], "<i4").astype(np.int64), sizes)
        near, far = mean_losses(units, np.array(row["targets"]), n, g, vocabulary)
        columns = [pa.array(row["ids"], pa.int64()), pa.array(sizes), pa.array(near), pa.array(far), pa.array(near - far)]
        return pa.table(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    asking = documents.select("batch", "ids", "sizes", "targets", "words", "code").groupBy("batch")
    answered = sums.select("batch", "part", "n", "good").groupBy("batch")
    scored = asking.cogroup(answered).applyInArrow(run, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")
    written = materialise(scored, "scores", rows_at_once=100)
    discard(documents, *answers)
    return written
