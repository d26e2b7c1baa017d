"""Bounded-space online best-fit packing of token sequences.

Documents become pieces of at most one sequence; a piece goes to the open sequence that it fills
best. A fixed number of sequences is open: a bitset with one bit per amount of free space answers
"smallest space that still holds n tokens" with a shift and a mask, and where one more sequence must be
opened, the fullest closes. Every task packs its own share of the pieces in a shuffled order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from readsift.session import stage

SEPARATOR = "<|endoftext|>"  # fixed value: the special string of the byte-level vocabulary
_OTHER_SPACE = re.compile(r"[^\S \n]")
_MARKS = ",.;:!?"
_RUNS = ("  ", "\n\n", " \n", "\n ")


class Words(dict):
    """Token ids (as bytes) of a word with what stands before it, asked from the library once.

    A mark after a letter is a word of its own to the library, so a word with one is looked up without it. When full,
    the words become the old ones; of these, those that are met again come back, and the rest go with the next turn.
    """

    def __init__(self, encode, before: str, kept: int) -> None:
        super().__init__()
        self._encode, self._before, self._kept = encode, before, kept
        self._old: dict[str, bytes] = {}
        self._marks = {mark: encode(mark) for mark in _MARKS}

    def __missing__(self, word: str) -> bytes:
        ids = self._old.pop(word, None)
        if ids is not None:
            pass
        elif word[-1:] in self._marks and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self._marks[word[-1]]
        else:
            ids = self._encode(self._before + word)
        if len(self) >= self._kept:
            self._old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The characters that a byte-level vocabulary writes bytes as, where they differ from the bytes' numbers."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_LETTERS = _byte_letters()
#: Letters below are letters in every version of Unicode.
_SETTLED = "\u0250"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    The library splits a text into words before it merges. Where single spaces and line ends stand
    between other characters, it splits there whatever follows, so words are encoded one by one
    and kept; any other text goes to the library whole, as do texts that hold the special string.
    """

    def __init__(self, path: str, kept: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._model = self._library.model
        self._spaced, self._bare = Words(self._word, " ", kept), Words(self._word, "", kept // 4)
        self._line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of one word with what stands before it. Letters alone are one word to the library too, so they go to its
        merges at once."""
        word = text[1:] if text[:1] == " " else text
        if not (word.isalpha() and (word.isascii() or max(word) < _SETTLED)):
            return self._whole(text)
        written = text.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
        return np.asarray([t.id for t in self._model.tokenize(written)], dtype="<u4").tobytes()

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self._bare[first] + b"".join(map(self._spaced.__getitem__, rest))

    def _uneven(self, text: str) -> bool:
        """Whether a space or line end stands at an end or beside another one."""
        return text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS) or bool(_OTHER_SPACE.search(text))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SEPARATOR in text or self._uneven(text):
            return self._whole(text)
        return self._line_end.join(map(self._line, text.split("\n")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenise documents and cut the long ones: rows (key, piece, start, length, ids), ``ids`` being the
    piece's token ids as little-endian unsigned 32-bit numbers. Every document ends with ``end_id``,
    so a null or empty text is one piece of one token. Other columns are left out."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = T.StructType([
        docs.schema[key],
        *T._parse_datatype_string("piece int, start bigint, length bigint, ids binary").fields,
    ])

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                ids = (made.encode(t) if isinstance(t, str) else b"") + end
                rows += [
                    (k, i, s, n, ids[4 * s : 4 * (s + n)])
                    for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))
                ]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return docs.select(key, text).mapInPandas(cut_up, schema)


class OpenBins:
    """At most ``limit`` open sequences, held by free space.

    ``place`` gives a piece's sequence and offset. Bit f of ``_mask`` is set while an open sequence has
    f tokens free.
    """

    def __init__(self, capacity: int, limit: int) -> None:
        self._capacity, self._limit = capacity, limit
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._mask = self._open = self._made = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self._mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self._capacity, self._made
            self._made += 1
            if length < free and self._open >= self._limit:
                self._take((self._mask & -self._mask).bit_length() - 1)  # the fullest closes
        if free > length:
            self._by_free[free - length].append(sequence)
            self._mask |= 1 << (free - length)
            self._open += 1
        return sequence, self._capacity - free

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        sequence = bins.pop()
        if not bins:
            self._mask &= ~(1 << free)
        self._open -= 1
        return sequence


def pack(
    items: DataFrame, capacity: int = 1024, length: str = "length", open_bins: int = 4096,
    per_task: int = 250_000, seed: int = 3,
) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: no sequence is longer than ``capacity`` and none has a gap.

    Items are dealt evenly, ``per_task`` to a task, and packed in a seeded order, which is the same
    when a task runs again; more to a task means fewer sequences left half full at its end. A task
    keeps ``open_bins`` numbers and one Arrow batch. Ids are unique across tasks, not consecutive.

    ``items`` should be staged. Lengths of null, below 1 or above ``capacity`` raise; equal rows are packed
    each for itself; no rows give none. Columns called like the two new ones are replaced.
    """
    items = items.drop("sequence_id", "offset")
    tasks = max(1, math.ceil(items.count() / per_task))
    order = F.xxhash64(F.lit(seed), *items.columns)
    dealt = items.repartition(tasks).withColumns({"_order": order, "_task": F.spark_partition_id().cast("bigint")})
    dealt = dealt.sortWithinPartitions("_order", *[c for c in items.columns if c != length], length)
    schema = T.StructType([
        *items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())
    ])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            if not batch[length].between(1, capacity).all():
                raise ValueError(f"lengths must lie between 1 and {capacity}")
            places = [bins.place(int(n)) for n in batch[length]]
            sequences, offsets = zip(*places) if places else ((), ())
            ids = (batch["_task"].to_numpy(np.int64) << 40) + np.asarray(sequences, dtype=np.int64)
            yield batch.drop(columns=["_order", "_task"]).assign(sequence_id=ids, offset=np.asarray(offsets, np.int64))

    return dealt.mapInPandas(packed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, n_tokens, ids) of packed pieces that still carry their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` of them
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id"
) -> DataFrame:
    """Tokenise, cut and pack: rows (key, piece, start, length, ids_crc32, sequence_id, offset).

    The ids themselves stay behind (their checksum is carried), so only a few numbers per piece are
    staged and dealt; ``pack(stage(pieces(...)))`` and :func:`sequences` give the sequences with ids.
    Null texts count as empty; repeated rows are packed each; no documents give no rows.
    """
    summed = pieces(docs, tokenizer_path, capacity, end_id, key).select(
        key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(stage(summed, "pieces"), capacity)
