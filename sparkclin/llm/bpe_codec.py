"""Byte-level BPE by two tiers of lookup, and its inverse.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a vocabulary entry to
its id in constant time. Tier two, for misses: the bytes of the pre-token are a doubly linked list, a heap holds
the candidate merges by (rank, place), and the lowest is taken until none is left. The hash is built once in each
Python worker from the rank file, whose size does not grow with the data.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map


class PerfectHash:
    """A minimal perfect hash (hash and displace): n keys to 0..n-1, with one displacement for each bucket."""

    def __init__(self, keys: list[bytes], shift: list[int] | None = None, load: int = 4):
        self.n = n = len(keys)
        self.m = m = max(1, n // load)
        self.shift = self._search(keys) if shift is None else shift
        self.slots = [b""] * n
        for k in keys:
            self.slots[self._place(k, self.shift[crc32(k) % m])] = k

    def _search(self, keys: list[bytes]) -> list[int]:
        """For each bucket, largest first, the first displacement that finds free slots for all its keys."""
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        for k in keys:
            buckets[crc32(k) % self.m].append(k)
        shift, taken = [0] * self.m, bytearray(self.n)
        for b in sorted(range(self.m), key=lambda i: -len(buckets[i])):
            d = 0
            while buckets[b]:
                at = [self._place(k, d) for k in buckets[b]]
                if len(set(at)) == len(at) and not any(taken[i] for i in at):
                    for i in at:
                        taken[i] = 1
                    shift[b] = d
                    break
                d += 1
        return shift

    def _place(self, key: bytes, d: int) -> int:
        x = (crc32(key, 0x9E3779B9) + d * 0x85EBCA6B) & 0xFFFFFFFFFFFF
        x ^= x >> 15
        x = x * 0x2C1B3C6D & 0xFFFFFFFFFFFF
        x ^= x >> 17
        return x % self.n

    def find(self, key: bytes) -> int:
        """The slot of ``key``, or -1: a key outside the set also hashes to a slot, so that slot's key is compared."""
        if not self.n:
            return -1
        i = self._place(key, self.shift[crc32(key) % self.m])
        return i if self.slots[i] == key else -1


class _Known(dict):
    """Ids of pre-tokens; those not known yet are resolved on the way."""

    def __init__(self, resolve):
        self.resolve = resolve

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.resolve(piece)
        return ids


#: The links of a short pre-token, to copy from.
_AFTER, _BEFORE = list(range(1, 257)), list(range(-1, 255))


class Codec:
    """Encodes texts by the ranks of a ``.tiktoken`` file and decodes ids, as that library would."""

    def __init__(self, path: str, pattern: str, shift: list[int] | None = None, keep: int = 300_000):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.bytes_of = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.hash = PerfectHash(list(self.bytes_of.values()), shift)
        ids = {token: rank for rank, token in self.bytes_of.items()}
        self.id_at = [ids[token] for token in self.hash.slots]
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        # \s there is Unicode's White_Space; regex's own \s also takes the separators 1C to 1F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.keep, self.known = keep, _Known(self.piece)
        self.pairs: dict[int, int | None] = {}
        self.byte_id = [ids[bytes([b])] for b in range(256)]

    def rank(self, token: bytes) -> int | None:
        i = self.hash.find(token)
        return None if i < 0 else self.id_at[i]

    def joined(self, left: int, right: int) -> int | None:
        """The id of two neighbours taken together, None where the vocabulary has no such entry."""
        r = self.pairs[left << 32 | right] = self.rank(self.bytes_of[left] + self.bytes_of[right])
        return r

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Tier two: merges by a heap over linked bytes. Heap entries hold rank and place, 2^32 apart."""
        ids = [self.byte_id[b] for b in token]
        n, get, missing = len(ids), self.pairs.get, -1
        after, before = (_AFTER[:n], _BEFORE[:n]) if n <= 256 else (list(range(1, n + 1)), list(range(-1, n - 1)))
        heap = []
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1], missing)
            if r == missing:
                r = self.joined(ids[i], ids[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            left = ids[i]
            j = after[i]
            if left < 0 or j >= n or get(left << 32 | ids[j], missing) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = get(r << 32 | ids[k], missing)
                if q == missing:
                    q = self.joined(r, ids[k])
                if q is not None:
                    push(heap, q << 32 | i)
            k = before[i]
            if k >= 0:
                q = get(ids[k] << 32 | r, missing)
                if q == missing:
                    q = self.joined(ids[k], r)
                if q is not None:
                    push(heap, q << 32 | k)
        return tuple(x for x in ids if x >= 0)

    def piece(self, piece: str) -> tuple[int, ...]:
        token = piece.encode()
        whole = self.rank(token)
        return (whole,) if whole is not None else self.merge(token)

    def encode(self, text: str) -> list[int]:
        pieces = self.split.findall(text)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        if len(self.pairs) > 4 * self.keep:
            self.pairs.clear()
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}
_shifts: dict[str, list[int]] = {}


def codec(path: str, pattern: str, shift: list[int] | None = None) -> Codec:
    """The codec of this process. ``shift``: the displacements as the driver found them, else they are searched for."""
    return _codecs.get((path, pattern)) or _codecs.setdefault((path, pattern), Codec(path, pattern, shift))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with ids (array of int) and n_tokens (long) of its text.

    One pass without a shuffle. A null or empty text gives no ids; texts of any length are encoded whole;
    repeated rows each give a row; an empty table gives an empty one; other columns are left out.
    """
    return _mapped(df, text, keep, "ids array<int>, n_tokens bigint", path, pattern, lambda c, t: ((ids := c.encode(t)), len(ids)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with decoded (binary), the bytes its ids stand for; null ids give no bytes."""
    return _mapped(df, ids, keep, "decoded binary", path, pattern, lambda c, x: (c.decode(x),))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes again: n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes."""

    def one(c: Codec, t: str) -> tuple[int, str, str]:
        ids = c.encode(t)
        written = ",".join(map(c.text_of.__getitem__, ids))
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _mapped(df, text, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern, one)


def _mapped(df: DataFrame, column: str, keep: tuple[str, ...], adds: str, path: str, pattern: str, one) -> DataFrame:
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), adds])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    new = [x.split() for x in adds.split(", ")]
    if path not in _shifts:  # searched for once, on the driver; a quarter of the vocabulary's size
        _shifts[path] = Codec(path, pattern).hash.shift
    shift = _shifts[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, shift)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                values = batch.column("__in")
                rows = [one(c, v.as_py() or ()) if not pa.types.is_string(values.type) else one(c, v.as_py() or "") for v in values]
                columns = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *columns], [*keep, *(n for n, _ in new)])

    return arrow_map(df.select(*keep, F.col(column).alias("__in")), run, fields)
