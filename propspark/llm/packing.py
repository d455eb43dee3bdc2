"""Bounded-space online best-fit packing of tokenised documents.

Every task tokenises its rows and packs them in one pass, without a shuffle. It keeps a fixed number of sequences open;
a bitset has a bit for every free space that an open sequence has, so the tightest one for a piece is the lowest set bit
at or above its length. When a new sequence is needed and all are in use, the fullest closes first.

A sequence never spans two tasks, so a lost executor only repeats its own tasks; input read from files gives the same
packing again. Sequence ids hold the number of the task in their upper bits.

Defined results: a null text is empty and becomes the end id alone; rows that repeat a doc_id each are packed; a null
doc_id stays null; an empty table gives an empty result; other columns are ignored. Strings that name special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from propspark.llm.common import text_of

CAPACITY = 1024
OPEN = 256
END_ID = 2
TOKENIZER = "byte_bpe_50k"
MEMO_WORDS = 200_000
# From here on scripts are left to the tokenizers library: the two libraries know different versions of Unicode.
PLAIN_BELOW = "ɐ"


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, equal to those of the tokenizers library.

    A single space before a non-space always begins a new token, so texts are cut there and the parts are looked up in a
    bounded memo; parts not yet in it are encoded together. Texts with two spaces in a row are encoded whole.
    """

    def __init__(self, name: str):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public.path(f"{name}.json"))
        self.exact.encode_special_tokens = True
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.sizes[rank] = len(word)
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if text and max(text) >= PLAIN_BELOW:
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if len(w) > 1 and max(w) < PLAIN_BELOW]
        ids = np.asarray(self.fast.encode_ordinary("".join(plain)), "<u4")
        ends = np.cumsum([len(w.encode()) for w in plain])
        at = np.cumsum(self.sizes[ids]) if len(ids) else np.zeros(0, np.int64)
        cuts = np.searchsorted(at, ends) + 1
        if len(plain) and np.array_equal(at[cuts - 1], ends):
            begin = 0
            for word, cut in zip(plain, cuts.tolist()):
                self.memo[word] = ids[begin:cut].tobytes()
                begin = cut
        for word in words:
            if word not in self.memo:
                self.memo[word] = self.whole(word)

    def ids(self, text: str) -> bytes:
        if "  " in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        words = [" " + w for w in rest]
        unknown = list(dict.fromkeys(w for w in words if w not in self.memo))
        if unknown:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
                unknown = list(dict.fromkeys(words))
            self._learn(unknown)
        return self.whole(first) + b"".join(map(self.memo.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


class BestFit:
    """Places pieces of up to ``capacity``; ``place`` gives the sequence's number and the offset in it."""

    def __init__(self, capacity: int, open_most: int):
        self.capacity, self.open_most = capacity, open_most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free_bits, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.open_most and length < self.capacity:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def piece_lengths(total: int, capacity: int) -> list[int]:
    """A document of up to ``capacity`` is one piece; of a longer one only the first piece may be shorter."""
    first = total % capacity or capacity
    return [first] + [capacity] * ((total - first) // capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, open_most: int = OPEN, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    kind = docs.schema["doc_id"].dataType
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(n, T.LongType()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bins = encoder(tokenizer), BestFit(capacity, open_most)
        base = TaskContext.get().partitionId() << 33
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = code.ids(text.as_py()) + end
                start = 0
                for piece, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    number, offset = bins.place(length)
                    row.append(i)
                    out.append((piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), base + number, offset))
                    start += length
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["doc_id", *names])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)
