"""Language-model scores by online logistic context mixing.

A text is its words, each with a space after it, and an end. The model decides before every word whether the text ends, and
predicts a word bit by bit. Seven predictors look counts up by context: the bytes before the bit in its byte, together with none,
one, two, three and four bytes before (hashed tables; for a word's first byte those are the last bytes of the word before), and
with the whole word so far, in all texts and in texts of the same kind. Those two counts are exact and come from all distinct
words of the corpus. A text's kind is the bucket (of 64, by hash) that most of its words
fall into, folded to sixteen; it mostly follows the most frequent word and costs four bits. Predictions are mixed in
the logistic domain by weights that a gate selects (place in the byte, first byte or not, how often the word so far has been
seen in the kind and in all, longest known hashed context), and an adaptive table corrects the mix by what followed such mixes.

What the model keeps of the corpus grows with it. Distinct words are counted, sorted and kept as blocks of neighbours: words that
begin alike stand together, so the counts of any beginning are sums over a stretch of rows, and one small list per block holds
what its first and last beginnings have in other blocks. Each beginning is predicted once, however many words share it, and
each distinct word gets its cost once; texts then only add up their words' costs. Costs of the most frequent words are sent to
the tasks, the others are joined; which words are which decides nothing but the way. The hashed tables grow with the number
of distinct words to at most ``MOST_BITS``, which bounds what is broadcast; they only smooth what the words so far have not seen.

Weights are learned online in every task, over all words: each beginning is predicted without one occurrence of itself, in
blocks whose bits come in random order, and the tasks' weights are averaged.

Defined results: a null text is empty and consists of the end alone; a null doc_id is the empty text and thus held out;
rows that repeat a doc_id each get a row and each count; other columns are ignored; an empty table gives an empty result.
Of words longer than ``REACH`` bytes what follows the next one is predicted by the hashed contexts alone. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from propspark.llm.common import stored, text_of

ORDERS = 5  # hashed contexts: none to four bytes
PREDICTORS = ORDERS + 2
LEAST_BITS, MOST_BITS = 16, 22
REACH = 24
DEPTHS = 8 * (REACH + 1) + 1
BLOCK_WORDS = 1 << 15
HEADS = 1 << 13  # heads of a learning step
HOT_WORDS = 1 << 19  # costs sent to the tasks
TABLE_PART = 4096  # slots
CHUNK = 4_000_000  # bytes of text looked at together
MEMO_BITS = 20
PAD = b"\n" * ORDERS
LEVELS = 6
KINDS = 16
BUCKETED = 64  # buckets of words that choose a text's kind
GATES = 16 * LEVELS * 3 * 3
BUCKETS = 49
PRIOR = 0.3  # every weight starts here
SPACE = 0x20
_U = np.uint64
_LEADING = np.array([8] + [7 - int(math.log2(x)) for x in range(1, 256)], np.int64)


def stream(text: str) -> tuple[bytes, int]:
    """The scored bytes of a text, tokens in lower case, one space between them and a line feed as the end; and the
    number of tokens with the end."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(tokens) + b"\n", len(tokens) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def word_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that stand one after the other."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(first, size)
    values = _mix(np.arange(256, dtype=np.uint64) + _U(1))
    factors = _mix(np.arange(int(size.max()), dtype=np.uint64) + _U(1 << 20)) | _U(1)
    sums = np.add.reduceat(values[data] * factors[place], first)
    return _mix(sums + _mix(size.astype(np.uint64)))


def words_in(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first places and lengths of the words in a buffer of bytes, in their order."""
    char = (u != 0x20) & (u != 0x0A)
    edge = np.diff(char.astype(np.int8), prepend=0, append=0)
    begin, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    return word_hashes(u[char], size), begin, size


class Chunk:
    """Some texts as one buffer: every stream has its padding before it."""

    def __init__(self, texts: list[str]):
        made = [stream(t) for t in texts]
        self.tokens = np.array([n for _, n in made], np.int64)
        self.bytes = np.array([len(s) for s, _ in made], np.int64)
        self.u = np.frombuffer(b"".join(PAD + s for s, _ in made), np.uint8)
        self.hashes, self.begin, self.size = words_in(self.u)
        self.doc = np.repeat(np.arange(len(texts)), self.tokens - 1)

    def kinds(self) -> np.ndarray:
        """The kind of every text: the fullest of its buckets of words by hash (of equals the first), folded to a few."""
        held = np.bincount(self.doc * BUCKETED + (self.hashes >> _U(64 - 6)).astype(np.int64), minlength=len(self.tokens) * BUCKETED)
        return held.reshape(-1, BUCKETED).argmax(axis=1) % KINDS

    def heads(self, kinds: np.ndarray) -> np.ndarray:
        """For every word its first byte, above it the four bytes before the separator, and above these its text's kind."""
        w = self.u[self.begin].astype(np.uint64) | (kinds[self.doc].astype(np.uint64) << _U(8 * ORDERS))
        for k in range(1, ORDERS):
            w |= self.u[self.begin - 1 - k].astype(np.uint64) << _U(8 * k)
        return w

    def pick(self, at: np.ndarray) -> pa.Array:
        """The words at some places of the list."""
        size = self.size[at]
        ends = np.cumsum(size)
        where = np.arange(int(size.sum())) + np.repeat(self.begin[at] - (ends - size), size)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.u[where].tobytes())]).cast(pa.binary())


def chunks(texts: list[str]) -> Iterator[tuple[int, int, Chunk]]:
    """(from, to, chunk) over the texts, about ``CHUNK`` characters at a time."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK or i == len(texts) - 1:
            yield begin, i + 1, Chunk(texts[begin:i + 1])
            begin, held = i + 1, 0


# --- hashed contexts -----------------------------------------------------------------------------------------------

def table_bits(distinct: int) -> tuple[int, ...]:
    """Slots (as powers of two) of the tables for contexts of none to four bytes, for so many distinct words."""
    most = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * distinct + 1))))
    return tuple(min(most, b) for b in (16, 16, 20, most, most))


def contexts(before: np.ndarray, head: bool) -> list[np.ndarray]:
    """Hashes of the contexts of none to four bytes; ``before`` holds the last byte in its lowest byte."""
    return [_mix((before & _U((1 << 8 * k) - 1)) * _U(32) + _U(k + 16 * head)) for k in range(ORDERS)]


def slots(keys: list[np.ndarray], node: np.ndarray, bits: tuple[int, ...]) -> list[np.ndarray]:
    step = node.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return [(((c + step) * _U(0x9E3779B97F4A7C15)) >> _U(64 - b)).astype(np.int64) for c, b in zip(keys, bits)]


def starts(kind: np.ndarray | None, n: int) -> np.ndarray:
    """Hashes of the context of being a word's first byte, of any or of one kind of texts; it stands for the word so far."""
    return _mix((np.zeros(n, np.uint64) if kind is None else kind.astype(np.uint64) + _U(1)) * _U(32) + _U(31))


def empty_tables(bits: tuple[int, ...], kind=np.uint16) -> list[np.ndarray]:
    return [np.zeros(2 << b, kind) for b in bits]


def squeezed(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as 16-bit numbers; a pair beyond them is scaled down together."""
    pairs = counts.reshape(-1, 2).astype(np.float64)
    top = np.maximum(pairs.max(axis=1, keepdims=True), 65535)
    return np.ceil(pairs * 65535 / top).astype(np.uint16).reshape(-1)


def split_heads(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte, the four bytes before the separator and the kind."""
    return w & _U(255), (w >> _U(8)) & _U((1 << 8 * (ORDERS - 1)) - 1), w >> _U(8 * ORDERS)


def add_heads(tables: list[np.ndarray], bits: tuple[int, ...], w: np.ndarray, n: np.ndarray) -> None:
    byte, before, kind = split_heads(w)
    keys, n = contexts(before, True), n.astype(tables[0].dtype)
    for j in range(8):
        node, bit = (byte >> _U(8 - j)) | _U(1 << j), ((byte >> _U(7 - j)) & _U(1)).astype(np.int64)
        for k, slot in enumerate(slots(keys, node, bits)):
            np.add.at(tables[k], slot * 2 + bit, n)
        for start in (starts(None, len(w)), starts(kind, len(w))):
            np.add.at(tables[0], slots([start], node, bits)[0] * 2 + bit, n)


class Block:
    """Neighbouring distinct words in their order, as rows of bytes that end with a space, and their counts by kind: pairs of a row
    and a kind, by kind and then row."""

    def __init__(self, data: np.ndarray, size: np.ndarray, row: np.ndarray, kind: np.ndarray, n: np.ndarray):
        self.data, self.size, self.row, self.kind, self.n = data, size, row, kind, n
        m = len(size)
        self.length = np.minimum(size, REACH) + 1  # bytes of a row that count
        self.rows = np.zeros((m, REACH + 1), np.uint8)
        self.ends = np.cumsum(size)
        kept = np.minimum(size, REACH + 1)
        at = np.repeat(np.arange(m), kept)
        col = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
        self.rows[at, col] = data[(self.ends - size)[at] + col]
        short = np.flatnonzero(size <= REACH)
        self.rows[short, size[short]] = SPACE
        self.total = np.bincount(row, weights=n, minlength=m).astype(np.int64)
        # Bits that a row shares with the one before it, in all and among the rows of a kind.
        self.shared, self.kind_shared = np.full(m, -1, np.int64), np.full(len(row), -1, np.int64)
        self.shared[1:] = shared_bits(self.rows[:-1], self.rows[1:])
        next_ = np.flatnonzero(kind[1:] == kind[:-1]) + 1
        self.kind_shared[next_] = shared_bits(self.rows[row[next_ - 1]], self.rows[row[next_]])

    def counts_along(self, like: np.ndarray) -> np.ndarray:
        """For every number of bits, the occurrences by kind of words that share so many first bits with the row ``like``."""
        held = np.zeros((DEPTHS, KINDS), np.int64)
        np.add.at(held, (shared_bits(like[None, :], self.rows)[self.row], self.kind), self.n)
        return np.cumsum(held[::-1], axis=0)[::-1]

    def beginnings(self, left: np.ndarray, right: np.ndarray, order: np.ndarray | None = None):
        """For every bit after the first byte: (byte, place in it, active pairs, their groups, which are alike up to and with the
        bit; of each group: its first row, the occurrences in the block, and in all texts and in the kind, anywhere, those of the
        same bit and of the other one). ``left`` and ``right`` are what the first and the last row's beginnings have in
        other blocks, by kind."""
        last = len(self.size) - 1
        longest = int(self.length.max(initial=0))
        inner_of, outer_of = np.zeros(last + 1, np.int64), np.zeros(last + 1, np.int64)
        lengths = self.length[self.row]
        for d in (np.arange(8, 8 * longest) if order is None else order[(order >= 8) & (order < 8 * longest)]):
            p, j = divmod(int(d), 8)
            rows = np.flatnonzero(self.length > p)
            at_outer, at_inner = np.flatnonzero(self.shared[rows] < d), np.flatnonzero(self.shared[rows] < d + 1)
            every, same = np.add.reduceat(self.total[rows], at_outer), np.add.reduceat(self.total[rows], at_inner)
            # The groups of the first and the last row go on in other blocks.
            begins, goes_on = rows[0] == 0, rows[-1] == last
            if begins:
                every[0], same[0] = every[0] + left[d].sum(), same[0] + left[d + 1].sum()
            if goes_on:
                every[-1], same[-1] = every[-1] + right[d].sum(), same[-1] + right[d + 1].sum()
            inner_of[rows] = np.repeat(np.arange(len(at_inner)), np.diff(np.append(at_inner, len(rows))))
            outer_of[rows] = np.repeat(np.arange(len(at_outer)), np.diff(np.append(at_outer, len(rows))))
            pairs = np.flatnonzero(lengths > p)
            outer, inner = self.kind_shared[pairs] < d, self.kind_shared[pairs] < d + 1
            k_outer, k_inner = np.flatnonzero(outer), np.flatnonzero(inner)
            n = self.n[pairs]
            own = np.add.reduceat(n, k_inner)
            k_every, k_same = np.add.reduceat(n, k_outer), own.copy()
            first = self.row[pairs[k_inner]]
            for groups, number, count, depth in ((k_outer, outer_of, k_every, d), (k_inner, inner_of, k_same, d + 1)):
                which, kind = number[self.row[pairs[groups]]], self.kind[pairs[groups]]
                if begins:
                    at = np.flatnonzero(which == 0)
                    count[at] += left[depth, kind[at]]
                if goes_on:
                    at = np.flatnonzero(which == number[last])
                    count[at] += right[depth, kind[at]]
            group = np.cumsum(inner) - 1
            k_other = k_every[(np.cumsum(outer) - 1)[k_inner]] - k_same
            all_same = same[inner_of[first]]
            yield p, j, pairs, group, first, own, all_same, every[outer_of[first]] - all_same, k_same, k_other

    def before(self, rows: np.ndarray, p: int) -> np.ndarray:
        """The four bytes before byte ``p``; a space stands before the word."""
        out = np.zeros(len(rows), np.uint64)
        for k in range(1, ORDERS):
            if p - k >= 0:
                out |= self.rows[rows, p - k].astype(np.uint64) << _U(8 * (k - 1))
            elif p - k == -1:
                out |= _U(SPACE << 8 * (k - 1))
        return out

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and windows (byte, and above it the four before it) of what long words have beyond their rows, with their ends."""
        long = np.flatnonzero(self.size > REACH)
        n = self.size[long] - REACH
        row = np.repeat(long, n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + REACH + 1
        first = (self.ends - self.size)[row]
        w = np.zeros(len(row), np.uint64)
        for k in range(ORDERS):
            at = place - k
            inside = at < self.size[row]
            w |= np.where(inside, self.data[np.where(inside, first + at, 0)] if len(self.data) else 0, SPACE).astype(np.uint64) << _U(8 * k)
        return row, w

    def add(self, tables: list[np.ndarray], bits: tuple[int, ...]) -> None:
        for p in range(1, int(self.length.max(initial=0))):
            rows = np.flatnonzero(self.length > p)
            keys = contexts(self.before(rows, p), False)
            for j in range(8):
                at = np.flatnonzero(self.shared[rows] < 8 * p + j + 1)
                own = np.add.reduceat(self.total[rows], at).astype(tables[0].dtype)  # of the tables' type, which is much faster to add
                byte = self.rows[rows[at], p].astype(np.int64)
                node, bit = (byte >> (8 - j)) | (1 << j), (byte >> (7 - j)) & 1
                for k, slot in enumerate(slots([c[at] for c in keys], node, bits)):
                    np.add.at(tables[k], slot * 2 + bit, own)
        for rows, (_, bit, at, _, _) in rest_bits(*self.rest(), bits):
            own = self.total[rows].astype(tables[0].dtype)
            for k, slot in enumerate(at):
                np.add.at(tables[k], slot * 2 + bit, own)


def rest_bits(row: np.ndarray, w: np.ndarray, bits: tuple[int, ...], step: int = 65536) -> Iterator[tuple[np.ndarray, tuple]]:
    """(rows, arguments of :meth:`Model.costs`) of the bits of :meth:`Block.rest`; nothing is known of the word so far."""
    for at in range(0, len(row), step):
        part, byte = w[at:at + step], w[at:at + step] & _U(255)
        keys, none = contexts(part >> _U(8), False), np.zeros(len(part), np.int64)
        for j in range(8):
            node, bit = (byte >> _U(8 - j)) | _U(1 << j), ((byte >> _U(7 - j)) & _U(1)).astype(np.int64)
            yield row[at:at + step], (j, bit, slots(keys, node, bits), [none] * 4, False)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits rows of bytes share."""
    x = a ^ b
    differ = x != 0
    at = np.argmax(differ, axis=1)
    return np.where(differ.any(axis=1), 8 * at + _LEADING[x[np.arange(len(x)), at]], DEPTHS - 1)


# --- mixing --------------------------------------------------------------------------------------------------------

class Model:
    def __init__(self, tables: list[np.ndarray], bits: tuple[int, ...]):
        self.tables, self.bits = tables, bits
        self.weights = np.full((GATES, PREDICTORS + 1), PRIOR)
        self.followed = np.zeros((4, LEVELS * 2 * BUCKETS))  # ones and zeros that followed, ones and zeros expected
        self._log = np.log(np.arange(65536) + 0.4)

    def inputs(self, j: int, bit: np.ndarray, at: list[np.ndarray], so_far, head: bool, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions (and a constant), the gate and the level of the word so far, whose counts ``so_far`` holds: zeros and
        ones in all texts, zeros and ones in texts of the kind. ``without`` takes one occurrence of the bit away."""
        x = np.empty((len(bit), PREDICTORS + 1))
        x[:, PREDICTORS] = 0.3
        known = np.zeros(len(bit), np.int64)
        one = bit == 1
        for k, slot in enumerate(at):
            c0, c1 = self.tables[k][slot * 2], self.tables[k][slot * 2 + 1]
            if without:
                c1, c0 = c1 - (one & (c1 > 0)), c0 - (~one & (c0 > 0))
            x[:, k] = self._log[c1] - self._log[c0]
            if k >= 3:
                known += (c0 > 0) | (c1 > 0)
        levels = []
        for k in (0, 2):
            n0, n1 = so_far[k], so_far[k + 1]
            if without:
                n0, n1 = n0 - (~one & (n0 > 0)), n1 - (one & (n1 > 0))  # beyond REACH nothing is counted
            x[:, ORDERS + k // 2] = np.log(n1 + 0.4) - np.log(n0 + 0.4)
            total = n0 + n1
            levels.append((total > 0).astype(np.int64) + (total > 1) + (total > 3) + (total > 15) + (total > 255))
        gate = (((j + 8 * head) * LEVELS + levels[1]) * 3 + np.minimum((levels[0] + 1) // 2, 2)) * 3 + known
        return x, gate, levels[1] + LEVELS * head

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -14, 14)

    @staticmethod
    def cell(level: np.ndarray, z: np.ndarray) -> np.ndarray:
        return level * BUCKETS + np.clip(np.rint(z * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)

    def costs(self, j, bit, at, so_far, head) -> np.ndarray:
        """Bits that each of some bits takes."""
        x, gate, level = self.inputs(j, bit, at, so_far, head, False)
        z = self.mixed(x, gate)
        ones, zeros, ones_due, zeros_due = self.followed
        c = self.cell(level, z)
        z = z + np.clip(np.log((ones[c] + 8) / (ones_due[c] + 8)) - np.log((zeros[c] + 8) / (zeros_due[c] + 8)), -1, 1)
        return np.logaddexp(0, np.where(bit == 1, -z, z)) / math.log(2)

    def learn(self, j, bit, at, so_far, head, n, bends, followed, mass) -> None:
        """One online Newton step per gate over some bits with their occurrences. ``bends`` holds decaying curvatures,
        ``followed`` what followed the mixes, ``mass`` the occurrences a gate."""
        x, gate, level = self.inputs(j, bit, at, so_far, head, True)
        mass += np.bincount(gate, weights=n, minlength=GATES)
        z = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-z))
        c = self.cell(level, z)
        for row, weight in enumerate((n * bit, n * (1 - bit), n * p, n * (1 - p))):
            followed[row] += np.bincount(c, weights=weight, minlength=followed.shape[1])
        order = np.argsort(gate, kind="stable")
        borders = np.flatnonzero(np.diff(gate[order], prepend=-1))
        for rows in np.split(order, borders[1:]):
            g, own = gate[rows[0]], x[rows]
            bends[g] = 0.95 * bends[g] + (own * (n[rows] * (p[rows] * (1 - p[rows]) + 1e-4))[:, None]).T @ own
            slope = own.T @ (n[rows] * (bit[rows] - p[rows])) + (PRIOR - self.weights[g])
            step = np.linalg.solve(bends[g] + 10 * np.eye(PREDICTORS + 1), slope)
            self.weights[g] += step / max(1.0, np.abs(step).max())

    def head_bits(self, w: np.ndarray):
        """The bits of words' first bytes: arguments of :meth:`costs`."""
        byte, before, kind = split_heads(w)
        keys = contexts(before, True)
        for j in range(8):
            node, bit = (byte >> _U(8 - j)) | _U(1 << j), ((byte >> _U(7 - j)) & _U(1)).astype(np.int64)
            so_far = []
            for start in (starts(None, len(w)), starts(kind, len(w))):
                slot = slots([start], node, self.bits)[0] * 2
                so_far += [self.tables[0][slot].astype(np.int64), self.tables[0][slot + 1].astype(np.int64)]
            yield j, bit, slots(keys, node, self.bits), so_far, True

    def head_costs(self, w: np.ndarray) -> np.ndarray:
        return sum((self.costs(*args) for args in self.head_bits(w)), np.zeros(len(w)))

    def block_bits(self, block: Block, left: np.ndarray, right: np.ndarray, order: np.ndarray | None = None):
        """(arguments of :meth:`costs`, occurrences in the block, active pairs, their groups) of a block's beginnings."""
        keys_at: dict[int, list[np.ndarray]] = {}
        for p, j, pairs, group, first, own, same, other, k_same, k_other in block.beginnings(left, right, order):
            if p not in keys_at:
                keys_at[p] = contexts(block.before(np.arange(len(block.size)), p), False)
            byte = block.rows[first, p].astype(np.int64)
            node, bit = (byte >> (8 - j)) | (1 << j), (byte >> (7 - j)) & 1
            one = bit == 1
            so_far = [np.where(one, other, same), np.where(one, same, other), np.where(one, k_other, k_same), np.where(one, k_same, k_other)]
            yield (j, bit, slots([c[first] for c in keys_at[p]], node, self.bits), so_far, False), own, pairs, group

    def word_costs(self, block: Block, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bits that the words of the block's pairs take after their first bytes, with the space after them."""
        out = np.zeros(len(block.row))
        for args, _, pairs, group in self.block_bits(block, left, right):
            out[pairs] += self.costs(*args)[group]
        row, w = block.rest()
        if len(row):
            rest = np.zeros(len(block.size))
            for rows, args in rest_bits(row, w, self.bits):
                np.add.at(rest, rows, self.costs(*args))
            out += rest[block.row]
        return out

    def learn_block(self, block: Block, left, right, bends, followed, mass, seed: int) -> None:
        order = np.random.default_rng(seed).permutation(DEPTHS - 1)
        for args, own, _, _ in self.block_bits(block, left, right, order):
            seen = np.flatnonzero(own)
            if len(seen):
                j, bit, at, so_far, head = args
                self.learn(j, bit[seen], [s[seen] for s in at], [s[seen] for s in so_far], head, own[seen], bends, followed, mass)
        row, w = block.rest()
        learned = block.total[row] > 0
        row, w = row[learned], w[learned]
        order = np.random.default_rng(seed).permutation(len(row))
        for rows, args in rest_bits(row[order], w[order], self.bits, HEADS):
            self.learn(*args, block.total[rows], bends, followed, mass)

    def learn_heads(self, w: np.ndarray, n: np.ndarray, bends, followed, mass, seed: int) -> None:
        order = np.random.default_rng(seed).permutation(len(w))
        for at in range(0, len(w), HEADS):
            part = order[at:at + HEADS]
            for args in self.head_bits(w[part]):
                self.learn(*args, n[part], bends, followed, mass)


# --- Spark jobs ----------------------------------------------------------------------------------------------------

def _sent(what: object) -> bytes:
    """For a broadcast: tables of a small corpus are mostly zeros."""
    return zlib.compress(pickle.dumps(what), 1)


def _received(data: bytes) -> object:
    return pickle.loads(zlib.decompress(data))


# What the last broadcast's tasks in this worker process share.
_KEPT: dict[str, object] = {}


def kept(name: str, make) -> object:
    """``make()``, once a worker process, which runs many tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(word, kind, n, every) and (head, n): occurrences of words by kind, and of heads, in the training texts; ``every`` counts
    those in all texts. ``texts``: text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "kind", "head", "n", "every"]
        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, c in chunks(b.column("text").to_pylist()):
                if not len(c.hashes):
                    continue
                kinds, learned = c.kinds(), ~held[lo:hi][c.doc]
                which, key = pd.factorize(word_keys(c.hashes, kinds[c.doc]))
                at = np.empty(len(key), np.int64)
                at[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # where each is first
                every, n = np.bincount(which), np.bincount(which[learned], minlength=len(key))
                yield pa.RecordBatch.from_arrays([c.pick(at), pa.array(kinds[c.doc[at]].astype(np.int32)), pa.nulls(len(key), pa.int64()), pa.array(n), pa.array(every)], names)
                which, head = pd.factorize(c.heads(kinds)[learned])
                n = np.bincount(which, minlength=len(head))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(head), pa.binary()), pa.nulls(len(head), pa.int32()), pa.array(head.view(np.int64)), pa.array(n), pa.array(n)], names)

    counted = texts.mapInArrow(run, "word binary, kind int, head long, n long, every long")
    return counted.groupBy("word", "kind", "head").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def word_keys(hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return _mix(hashes + kinds.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


_BLOCK = ("part int, data binary, size binary, row binary, kind binary, n binary, every binary, left binary, right binary, "
          "first binary, last binary, along_first binary, along_last binary, tokens long, distinct long")


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpacked(b, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b.as_py()), kind)


def blocks_of(words: DataFrame) -> DataFrame:
    """The distinct words in their order, in blocks of ``BLOCK_WORDS``, with what the beginnings of a block's first and last word
    have in the other blocks of its partition, and what a partition's have in it."""
    key = F.substring(F.concat("word", F.lit(b" ")), 1, REACH + 1)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (words.withColumn("key", key).repartitionByRange(parts, "key", "word").sortWithinPartitions("key", "word", "kind")
             .withColumn("part", F.spark_partition_id()).select("part", "word", "kind", "n", "every"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = held[0].column("part")[0].as_py()
        t = pa.Table.from_batches(held)
        word, kind, n, every = (t.column(c).combine_chunks() for c in ("word", "kind", "n", "every"))
        offsets = np.frombuffer(word.buffers()[1], np.int32)[word.offset:word.offset + len(word) + 1]
        data, size = np.frombuffer(word.buffers()[2] or b"", np.uint8), np.diff(offsets).astype(np.int64)
        hashes = word_hashes(data[offsets[0]:offsets[-1]], size)
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])  # one row a kind
        begin = np.append(np.flatnonzero(new), len(size))
        kind, n, every = kind.to_numpy(), n.to_numpy(), every.to_numpy()
        made = []
        for at in range(0, len(begin) - 1, BLOCK_WORDS):
            edge = begin[at:at + BLOCK_WORDS + 1]
            lo, hi = edge[0], edge[-1]
            row = np.cumsum(new[lo:hi]) - 1
            order = np.lexsort((row, kind[lo:hi]))
            only = begin[at:at + len(edge) - 1]
            bytes_ = np.concatenate([data[offsets[i]:offsets[i + 1]] for i in only])
            made.append((Block(bytes_, size[only], row[order], kind[lo:hi][order], n[lo:hi][order]), every[lo:hi][order]))
        first, last = made[0][0].rows[0], made[-1][0].rows[-1]
        zero = np.zeros((DEPTHS, KINDS), np.int64)
        lefts, rights = beside([b for b, _ in made])
        along_first, along_last = sum((b.counts_along(first) for b, _ in made), zero), sum((b.counts_along(last) for b, _ in made), zero)
        for i, (b, all_) in enumerate(made):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (
                (part, pa.int32()), (b.data.tobytes(), pa.binary()), (_packed(b.size), pa.binary()), (_packed(b.row), pa.binary()), (_packed(b.kind.astype(np.int64)), pa.binary()),
                (_packed(b.n), pa.binary()), (_packed(all_), pa.binary()), (_packed(lefts[i]), pa.binary()), (_packed(rights[i]), pa.binary()),
                (first.tobytes(), pa.binary()), (last.tobytes(), pa.binary()), (_packed(along_first) if i == 0 else None, pa.binary()),
                (_packed(along_last) if i == 0 else None, pa.binary()), (int(b.n.sum()), pa.int64()), (int((b.total > 0).sum()), pa.int64()))], names)

    names = [f.split()[0] for f in _BLOCK.split(", ")]
    return dealt.mapInArrow(run, _BLOCK)


def _carried(firsts: list[np.ndarray], lasts: list[np.ndarray], along: list[np.ndarray]) -> list[np.ndarray]:
    """What the beginnings of each stretch's first row have in the stretches before it, in one pass: ``along`` is what those of a
    stretch's last row have in the stretch itself."""
    out = [np.zeros((DEPTHS, KINDS), np.int64)]
    for i in range(1, len(firsts)):
        own, held = along[i - 1].copy(), out[-1].copy()
        own[int(shared_bits(firsts[i][None, :], lasts[i - 1][None, :])[0]) + 1:] = 0
        held[int(shared_bits(firsts[i][None, :], firsts[i - 1][None, :])[0]) + 1:] = 0
        out.append(own + held)
    return out


def beside(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Left and right of every block: what its first and last beginnings have in the blocks before and after it."""
    firsts, lasts = [b.rows[0] for b in blocks], [b.rows[-1] for b in blocks]
    left = _carried(firsts, lasts, [b.counts_along(b.rows[-1]) for b in blocks])
    right = _carried(lasts[::-1], firsts[::-1], [b.counts_along(b.rows[0]) for b in blocks[::-1]])[::-1]
    return left, right


def borders(blocks: DataFrame) -> dict[int, tuple[bytes, bytes, bytes, bytes]]:
    """By partition: its first and last row, and what their beginnings have in other partitions. One row a partition."""
    rows = blocks.where("along_first is not null").select("part", "first", "last", "along_first", "along_last").orderBy("part").collect()
    shape = (DEPTHS, KINDS)
    firsts, lasts = ([np.frombuffer(r[c], np.uint8) for r in rows] for c in ("first", "last"))
    along_first, along_last = ([np.frombuffer(zlib.decompress(r[c]), np.int64).reshape(shape) for r in rows] for c in ("along_first", "along_last"))
    left = _carried(firsts, lasts, along_last)
    right = _carried(lasts[::-1], firsts[::-1], along_first[::-1])[::-1]
    return {r["part"]: (bytes(r["first"]), bytes(r["last"]), _packed(a), _packed(b)) for r, a, b in zip(rows, left, right)}


def _block_of(b: pa.RecordBatch, i: int) -> Block:
    size, row, kind, n = (_unpacked(b.column(c)[i]) for c in ("size", "row", "kind", "n"))
    return Block(np.frombuffer(b.column("data")[i].as_py(), np.uint8), size, row, kind, n)


def _blocks_with_borders(b: pa.RecordBatch, edges: dict) -> Iterator[tuple[int, Block, np.ndarray, np.ndarray]]:
    for i in range(b.num_rows):
        block = _block_of(b, i)
        left, right = (_unpacked(b.column(c)[i]).reshape(DEPTHS, KINDS).copy() for c in ("left", "right"))
        first, last, more_left, more_right = edges[b.column("part")[i].as_py()]
        for held, more, row, edge in ((left, more_left, block.rows[0], first), (right, more_right, block.rows[-1], last)):
            upto = int(shared_bits(row[None, :], np.frombuffer(edge, np.uint8)[None, :])[0]) + 1
            held[:upto] += np.frombuffer(zlib.decompress(more), np.int64).reshape(DEPTHS, KINDS)[:upto]
        yield i, block, left, right


def fit(blocks: DataFrame, heads: DataFrame, distinct: int, edges: dict) -> Model:
    """The model of the blocks and of counted heads (head, n). What reaches the driver is bounded by the tables' size and, for the
    weights, by some kilobytes a task, added up in eight groups first."""
    spark = blocks.sparkSession
    bits = table_bits(distinct)

    def emitted(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(tables):
            for at in range(0, len(t), 2 * TABLE_PART):
                part = t[at:at + 2 * TABLE_PART]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k << 32 | at]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "data"])

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = empty_tables(bits, np.int32)
        for b in batches:
            for i in range(b.num_rows):
                _block_of(b, i).add(tables, bits)
        yield from emitted(tables)

    def tabulate_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = empty_tables(bits, np.int32)
        for b in batches:
            add_heads(tables, bits, b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy())
        yield from emitted(tables)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(zlib.decompress(data.as_py()), np.int32).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([zlib.compress(squeezed(part).tobytes(), 1)], pa.binary())], ["block", "data"])

    kind = "block long, data binary"
    tables = empty_tables(bits)
    counted = blocks.select("data", "size", "row", "kind", "n").mapInArrow(tabulate, kind).union(heads.mapInArrow(tabulate_heads, kind))
    for row in counted.repartition("block").mapInArrow(total, kind).collect():  # at most the size of the tables
        at = row["block"] & 0xFFFFFFFF
        tables[row["block"] >> 32][at:at + 2 * TABLE_PART] = np.frombuffer(zlib.decompress(row["data"]), np.uint16)
    model = Model(tables, bits)
    shared = spark.sparkContext.broadcast(_sent((model, edges)))

    def started() -> tuple[Model, dict, np.ndarray, np.ndarray, np.ndarray]:
        own, own_edges = _received(shared.value)
        return own, own_edges, np.zeros((GATES, PREDICTORS + 1, PREDICTORS + 1)), np.zeros_like(own.followed), np.zeros(GATES)

    def learned(own: Model, followed: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (mass, own.weights * mass[:, None], followed)], ["mass", "weights", "followed"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_edges, bends, followed, mass = started()
        for at, b in enumerate(batches):
            for i, block, left, right in _blocks_with_borders(b, own_edges):
                own.learn_block(block, left, right, bends, followed, mass, 1000 * at + i)
        yield learned(own, followed, mass)

    def learn_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, bends, followed, mass = started()
        for at, b in enumerate(batches):
            own.learn_heads(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), bends, followed, mass, at)
        yield learned(own, followed, mass)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            for i in range(b.num_rows):
                part = [np.frombuffer(b.column(c)[i].as_py()) for c in ("mass", "weights", "followed")]
                sums = part if sums is None else [x + y for x, y in zip(sums, part)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], ["mass", "weights", "followed"])

    kind = "mass binary, weights binary, followed binary"
    every = blocks.select("part", "data", "size", "row", "kind", "n", "left", "right").mapInArrow(learn, kind).union(heads.mapInArrow(learn_heads, kind))
    rows = every.repartition(8).mapInArrow(merge, kind).collect()  # at most 8 rows
    shared.destroy()
    if rows:
        mass, weights, followed = (sum(np.frombuffer(r[c]) for r in rows) for c in ("mass", "weights", "followed"))
        seen = mass > 0  # words' and heads' gates differ
        model.weights[seen] = weights.reshape(model.weights.shape)[seen] / mass[seen, None]
        model.followed = followed.reshape(model.followed.shape)
    return model


def priced(blocks: DataFrame, model, edges_name: str) -> DataFrame:
    """(key, n, bits, every): every distinct word and kind with its count in training, its cost and its count in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, edges = kept(edges_name, lambda: _received(model.value))
        for b in batches:
            for i, block, left, right in _blocks_with_borders(b, edges):
                key = word_keys(word_hashes(block.data, block.size)[block.row], block.kind)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(block.total[block.row]), pa.array(own.word_costs(block, left, right)),
                                                  pa.array(_unpacked(b.column("every")[i]))], ["key", "n", "bits", "every"])

    columns = ["part", "data", "size", "row", "kind", "n", "every", "left", "right"]
    return blocks.select(*columns).mapInArrow(run, "key long, n long, bits double, every long")


def hot_words(words: DataFrame, most: int = HOT_WORDS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count that keeps the words at or above it within ``most``, a power of two, and their sorted keys, counts in
    training and costs."""
    sizes = {r["k"]: r["c"] for r in words.groupBy(F.floor(F.log2("every")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = 63, 0
    for k in range(62, -1, -1):
        held += sizes.get(k, 0)
        if held > most:
            break
        least = k
    if least == 63:
        return 1 << least, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    rows = words.where(F.col("every") >= F.lit(1 << least)).select("key", "n", "bits").toArrow()
    key = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return 1 << least, key[order], rows.column("n").to_numpy()[order], rows.column("bits").to_numpy()[order]


class Heads:
    """Costs of heads with a direct-mapped memo: most heads come again."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << MEMO_BITS, (1 << 64) - 1, np.uint64)
        self.kept = np.zeros(1 << MEMO_BITS)

    def costs(self, w: np.ndarray) -> np.ndarray:
        at = ((w * _U(0x9E3779B97F4A7C15)) >> _U(64 - MEMO_BITS)).astype(np.int64)
        out = self.kept[at]
        miss = np.flatnonzero(self.keys[at] != w)
        if len(miss):
            new, where = np.unique(w[miss], return_inverse=True)
            cost = np.concatenate([self.model.head_costs(new[i:i + 65536]) for i in range(0, len(new), 65536)])
            out[miss] = cost[where]
            slot = ((new * _U(0x9E3779B97F4A7C15)) >> _U(64 - MEMO_BITS)).astype(np.int64)
            self.keys[slot], self.kept[slot] = new, cost
            self.kept[slot] = np.where(self.keys[slot] == new, cost, self.kept[slot])
        return out


def score(docs: DataFrame, keep: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document. The model
    learns from documents whose crc32 of the id as text is not divisible by ``keep``."""
    spark = docs.sparkSession
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text_of(docs).alias("text"), (F.crc32(F.encode(ids, "UTF-8")) % keep == 0).alias("held_out"))
    n_train = rows.where("not held_out").count()
    counts = stored(corpus_counts(rows.select("text", "held_out")))
    blocks = stored(blocks_of(counts.where("word is not null").select("word", "kind", "n", "every")))
    sums = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    train_tokens, distinct = sums["n"] + n_train, sums["v"] + (n_train > 0)
    edges = borders(blocks)
    model = fit(blocks, counts.where("head is not null and n > 0").select("head", "n"), distinct, edges)
    name = uuid.uuid4().hex
    words = stored(priced(blocks, spark.sparkContext.broadcast(_sent((model, edges))), f"{name}-words"))
    least, *hot = hot_words(words)
    ending = (n_train + 0.1) / (train_tokens + 0.2)  # the share of ends
    shared = spark.sparkContext.broadcast(_sent((model, *hot)))
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_bytes", "n_hot")),
                           T.StructField("hot_score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("cold", T.ArrayType(T.LongType()))])

    def prepared():
        own, *found = _received(shared.value)
        return Heads(own), *found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, hot, hot_n, hot_bits = kept(name, prepared)
        hot_log = np.log10(hot_n + 0.1)
        for b in batches:
            for lo, hi, c in chunks(b.column("text").to_pylist()):
                kinds, m = c.kinds(), hi - lo
                bits = -(c.tokens - 1) * math.log2(1 - ending) - math.log2(ending) + math.log2(KINDS)
                found = np.zeros(len(c.hashes), bool)
                part, n_hot = np.zeros(m), np.zeros(m, np.int64)
                key = word_keys(c.hashes, kinds[c.doc])
                if len(key):
                    which, head = pd.factorize(c.heads(kinds))
                    bits = bits + np.bincount(c.doc, weights=heads.costs(head)[which], minlength=m)
                if len(key) and len(hot):
                    which, word = pd.factorize(key)
                    at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
                    found = (hot[at] == word)[which]
                    doc, at = c.doc[found], at[which[found]]
                    bits = bits + np.bincount(doc, weights=hot_bits[at], minlength=m)
                    part = np.bincount(doc, weights=hot_log[at], minlength=m)
                    n_hot = np.bincount(doc, weights=hot_n[at] > 0, minlength=m).astype(np.int64)
                n_cold = np.cumsum(np.bincount(c.doc[~found], minlength=m))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n_cold]), pa.int32()), pa.array(key[~found].view(np.int64)))
                own = b.slice(lo, m)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), own.column("held_out"), pa.array(c.tokens), pa.array(c.bytes),
                                                  pa.array(n_hot), pa.array(part), pa.array(bits), lists], schema.names)

    scored = stored(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text", "held_out").mapInArrow(run, schema))
    rare = words.where(F.col("every") < F.lit(least))
    looked = (scored.select("row", F.explode("cold").alias("key")).join(rare, "key", "left").groupBy("row")
              .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("cold_score"), F.count_if(F.col("n") > 0).alias("n_cold"), F.sum("bits").alias("cold_bits")))
    end = math.log10(n_train + 0.1)
    all_of = F.lit(math.log10(train_tokens + 0.1 * (distinct + 1)))
    bits = F.col("bits") + F.coalesce("cold_bits", F.lit(0.0))
    return scored.drop("cold").join(looked, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + F.lit(int(n_train > 0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * all_of).alias("base_score"),
        (bits * F.lit(-math.log10(2))).alias("score"), (bits / F.col("n_bytes")).alias("bits_per_byte"))
