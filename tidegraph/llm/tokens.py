"""Exact tokenization with a public vocabulary, through a bounded cache of pieces.

Both kinds of vocabulary in use split a text first, and never keep together what lies
before and after a space between two other characters.  A text is therefore cut at its
spaces and every distinct piece of a block is tokenized once: plain Latin words (with a
full stop or comma behind them) by the library's model alone, all other pieces by its
whole pipeline.  Texts with longer or unusual runs of white space, or with the string of
an added token, go to the pipeline whole.  Cutting, counting and putting together run in Arrow.  A worker process keeps at
most ``CACHE_PIECES`` pieces, those used last, between blocks and tasks.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 500_000
#: Longer pieces are rare words; keeping them would only cost memory.
CACHED_BYTES = 64
#: Bytes of the texts whose pieces are looked up together.
BLOCK_BYTES = 6 << 20
#: Code points of white space other than space and line feed.
_SPACES = (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_UNUSUAL = re.compile(f"[{''.join(map(chr, _SPACES))}]")
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Words in one call of the model.
_CALL = 500


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name printable bytes by themselves and the others by code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_NAMES = _byte_names()


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _of_lengths(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.uint32, copy=False)))


class Encoder:
    """Texts to unsigned 32-bit ids in the machine's order, which is little-endian here.

    ``keeps_space`` says whether a leading space is part of a piece (byte-level
    vocabularies) or dropped, with letters lower-cased (vocabularies with word ends).
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        if sys.byteorder != "little":
            raise NotImplementedError("ids are stored in little-endian order")
        self._tokenizer = _load(path)
        self._keeps_space = keeps_space
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # the same model behind a plain split, for words that are already written in its alphabet
        self._words_only = Tokenizer(self._tokenizer.model)
        self._words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._lead = _BYTE_NAMES[32] if keeps_space else ""
        names = self._tokenizer.get_vocab()
        self._edge = np.zeros(max(names.values()) + 1, dtype=bool)  # ids that begin, or else end, a word
        for name, number in names.items():
            self._edge[number] = name.startswith(self._lead) if keeps_space else name.endswith("</w>")
        self._pieces = pa.array([], pa.string())
        self._ids = _of_lengths(np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64))
        self._used = np.empty(0, dtype=np.int64)
        self._block = 0

    def _by_pipeline(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _plain(self, names: list[str], words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all names, each of so many words, and how many ids each name has."""
        calls = [" ".join(names[at : at + _CALL]) for at in range(0, len(names), _CALL)]
        found = self._words_only.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), dtype=np.uint32)
        edges = np.flatnonzero(self._edge[ids])
        if self._keeps_space:
            bounds = np.append(edges, len(ids))  # a mark behind a word begins no word
        else:
            bounds = np.concatenate([[0], edges[np.cumsum(words) - 1] + 1]) if names else np.zeros(1, dtype=np.int64)
        lengths = np.diff(bounds)
        if len(lengths) != len(names):
            raise RuntimeError("the vocabulary does not mark its words as expected")
        return ids, lengths

    def _learn(self, pieces: list[str]) -> pa.ListArray:
        """The ids of every piece, as it stands behind a space."""
        names, words, plain, rest = [], [], [], []
        lead, folds = self._lead, not self._keeps_space
        for number, piece in enumerate(pieces):
            mark = piece[-1:] if piece[-1:] in (".", ",") else ""
            word = piece[:-1] if mark else piece
            ascii_word = word.isascii()
            if not (word.isalpha() and (ascii_word or _LATIN.fullmatch(word))):
                rest.append(number)
                continue
            if folds:
                word = word.lower()
            if not ascii_word:
                word = word.encode().decode("latin-1").translate(_BYTE_NAMES)
            names.append(f"{lead}{word} {mark}" if mark else lead + word)
            words.append(2 if mark else 1)
            plain.append(number)
        ids, lengths = self._plain(names, words)
        odd = self._by_pipeline([(" " if self._keeps_space else "") + pieces[n] for n in rest])
        both = _of_lengths(
            np.concatenate([ids, np.frombuffer(b"".join(odd), dtype=np.uint32)]),
            np.concatenate([lengths, np.array([len(x) // 4 for x in odd], dtype=np.int64)]),
        )
        place = np.empty(len(pieces), dtype=np.int64)
        place[np.array(plain + rest, dtype=np.int64)] = np.arange(len(pieces))
        return both.take(pa.array(place))

    def _lookup(self, pieces: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """A table of ids and the place of each of these distinct pieces in it."""
        self._block += 1
        at = pc.index_in(pieces, value_set=self._pieces)
        is_new = at.is_null()
        new = pieces.filter(is_new)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = is_new.to_numpy(zero_copy_only=False)
        place[fresh] = len(self._pieces) + np.arange(len(new))
        table = pa.concat_arrays([self._ids, self._learn(new.to_pylist())])
        used = np.concatenate([self._used, np.full(len(new), self._block)])
        used[place] = self._block
        kept_pieces = pa.concat_arrays([self._pieces, new])
        if len(used) > CACHE_PIECES:
            short = pc.less_equal(pc.binary_length(kept_pieces), CACHED_BYTES).to_numpy(zero_copy_only=False)
            oldest = np.partition(used, len(used) - CACHE_PIECES // 2)[len(used) - CACHE_PIECES // 2]
            stay = np.flatnonzero(short & (used >= oldest))[-CACHE_PIECES:]
            self._pieces, self._ids, self._used = kept_pieces.take(pa.array(stay)), table.take(pa.array(stay)), used[stay]
        else:
            self._pieces, self._ids, self._used = kept_pieces, table, used
        return table, place

    def _encode_cut(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of the pieces of each text, each as it stands behind a space; None: no piece."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        coded = pc.list_flatten(lists).dictionary_encode()
        del lists
        table, place = self._lookup(coded.dictionary)
        taken = table.take(pa.array(place[coded.indices.to_numpy()]))
        del coded, table
        starts = taken.offsets.to_numpy()
        ids = memoryview(taken.values.to_numpy()).cast("B")
        at = 0
        for end in ends:
            yield bytes(ids[4 * starts[at] : 4 * starts[end]])
            at = end

    def _holds_added(self, text: str) -> bool:
        """Whether the string of an added token, which comes before any split, is in the text."""
        return any(token in text for token in self._added)

    def _is_whole(self, text: str) -> bool:
        """Whether white space that belongs together may touch a space, or an added token is in the text."""
        return self._holds_added(text) or "  " in text or " \n" in text or "\n " in text or _UNUSUAL.search(text) is not None

    def encode_block(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; empty for a null or empty text."""
        block = [t or "" for t in texts]
        if not self._keeps_space:
            whole = [self._holds_added(t) for t in block]
            cut = self._encode_cut([None if w else t.replace("\n", " ") for t, w in zip(block, whole, strict=True)])
            for text, is_whole, ids in zip(block, whole, cut, strict=True):
                yield self._by_pipeline([text])[0] if is_whole else ids
            return
        # the first piece has no space in front of it, so the pipeline takes it
        heads, rest = [], []
        for text in block:
            head, space, tail = (text, "", "") if self._is_whole(text) else text.partition(" ")
            heads.append(head)
            rest.append(tail if space else None)
        for head, tail in zip(self._by_pipeline(heads), self._encode_cut(rest), strict=True):
            yield head + tail

    def encode_rows(self, batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, bytes]]]:
        """Blocks of (id, ids of the text) from a batch of ids and texts; a block holds about ``BLOCK_BYTES`` of text."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
            part = batch.slice(at, end - at)
            ids = self.encode_block(part.column(1).to_pylist())
            yield list(zip(part.column(0).to_pylist(), ids, strict=True))
            pa.default_memory_pool().release_unused()
            at = end


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """The worker's encoder for this vocabulary, kept between tasks."""
    return Encoder(path, keeps_space)
