"""Removal of repeated substrings by suffix arrays of linear grouping construction.

Every string of ``length`` bytes that starts in two places or more, in one document or in several, is removed
wherever it occurs. The suffixes of a corpus fit no machine, so they are dealt out by content first:

1. Each window of ``length`` bytes elects an anchor, its k-gram of least hash (the leftmost of equals). Equal windows
   elect equal anchors at the same offset, and neighbouring windows mostly share theirs, so one anchor stands for a
   context: the windows that elected it. Contexts whose anchor occurs once hold no repeated window.
2. Equal contexts count once, with their number as weight. Contexts of an anchor meet in one task, where they are
   written as sequences of fixed-size blocks aligned to the anchor, as equal windows lie alike around it.
3. A suffix array over the blocks is built by linear grouping: suffixes are grouped by their Lyndon prefixes, the
   groups processed in descending order by previous-smaller pointers, then each group's order is emitted from the
   smallest suffix on, without renaming and recursion. Neighbours that share all whole blocks of a window form runs;
   the few bytes at both ends that whole blocks leave open are compared exactly.
   The contexts of an anchor that occurs very often do not meet: their windows are counted one by one, by a digest.
4. The repeated windows go back to all documents that hold the context, are united to maximal runs, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map, fresh_key_long, written

GRAM, BLOCK = 40, 32
#: Different contexts of one anchor, as estimated, up to which they are held together in a task: about 200,000 symbols.
HOT = 20_000
#: Bytes whose contexts are found at a time; longer texts are taken in pieces that overlap by a window.
PIECE = 1 << 20
_B = 0x9E3779B97F4A7C15
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as many as were ever asked for."""

    def __init__(self):
        self.inverse, self.up, self.down = pow(_B, -1, 1 << 64), np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            size = max(1024, len(self.up) * 2)
            self.up = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, _B, _U)])
            self.down = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, self.inverse, _U)])


_powers = _Powers()


class Hashes:
    """Hashes of any substring of a byte array, by prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        _powers.upto(n + 1)
        scrambled = _mixed(np.arange(1, 257, dtype=_U) * _U(_B))[data]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(scrambled * _powers.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _powers.down[start]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of ``w``, by windows of doubling size."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def contexts(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor of the texts: text, anchor hash, context hash, first and last window, place of the anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes = Hashes(data)
    grams = _mixed((hashes.sums[gram:] - hashes.sums[:-gram]) * _powers.down[: n - gram + 1])
    # the upper bits of the hash, then the place: ties go to the leftmost
    place_bits = max(24, n.bit_length())
    mask = (1 << place_bits) - 1
    keyed = (grams & _U(~mask & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(grams), dtype=_U)
    chosen = (_sliding_min(keyed, length - gram + 1) & _U(mask)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    window = np.arange(len(chosen))
    inside = window + length <= ends[owner]
    window, chosen, owner = window[inside], chosen[inside], owner[inside]
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(window)] - 1
    a, b, p, t = window[first], window[last], chosen[first], owner[first]
    anchor = grams[p]
    shape = ((p - a) << 32 | (b - a)).astype(_U)
    context = _mixed(_mixed(hashes.of(a, b + length)) + _mixed(shape + _U(1)))
    base = (ends - sizes)[t]
    return t, anchor.view(np.int64), context.view(np.int64), a - base, b - base, p - base


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of non-negative integers by grouping (a shorter suffix precedes its extensions).

    First phase: groups start as the suffixes with equal first symbol and are processed in descending order. Each
    suffix of a group points to the nearest one before it in a smaller group. The suffixes pointed to leave their
    group for a new one right above it, those with more pointers higher, as the group's string follows theirs as
    often. Pointers jump over what has been processed, so the phase takes linear time; groups end as equal Lyndon
    prefixes. Second phase: from the smallest suffix on, the one before it, and its chain of pointers, take the next
    places of their groups.
    """
    n = len(symbols)
    if n == 0:
        return []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[c]:
            group[i] = g
    above[-1] = -1
    UNSET = -2
    before = [UNSET] * n
    order: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) > 1:
            own = [i for i in own if group[i] == g]
        elif own and group[own[0]] != g:
            own = []
        members[g] = own
        order.append(g)
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while j >= 0 and before[j] != UNSET:
                j = before[j]
            before[i] = j
            if j >= 0:
                old = group[j]
                group[j] = new = len(members)
                members.append([j])
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new
        elif own:
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and before[j] != UNSET:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                moves.setdefault((-times, group[j]), []).append(j)
            for times, old in sorted(moves):
                moved = moves[times, old]
                new = len(members)
                members.append(moved)
                for j in moved:
                    group[j] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new
        g = below[g]
    # places of the groups, from the smallest on
    start = [0] * len(members)
    at = 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = bytearray(n)
    # the last suffix is its own Lyndon prefix and the first of its group
    i = n - 1
    while i >= 0 and not placed[i]:
        g = group[i]
        out[start[g]] = i
        start[g] += 1
        placed[i] = 1
        i = before[i]
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            placed[i] = 1
            i = before[i]
    return out


def repeated_windows(parts: list[bytes], offsets: list[int], weights: list[int], length: int, block: int = BLOCK) -> np.ndarray:
    """(context, window) pairs of the windows that occur twice or more among the contexts, each as often as its weight.

    ``offsets`` has the place of the anchor in each context.
    """
    whole = (length - block + 1) // block  # blocks that lie in a window whatever its alignment
    data = np.frombuffer(b"".join(parts) + bytes(length), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    head = np.array(offsets, np.int64) % block
    count = (sizes - head) // block
    # block starts of all contexts, and after each context one separator
    total = count + 1
    owner = np.repeat(np.arange(len(parts)), total)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
    real = rank < count[owner]
    at = begin[owner] + head[owner] + rank * block
    rows = sliding_window_view(data, block)[at[real]]
    _, symbol = np.unique(rows.view(f"V{block}").ravel(), return_inverse=True)
    symbols = np.zeros(len(owner) + whole, np.int64)
    symbols[: len(owner)][real] = symbol + 1
    order = np.array(suffix_array(symbols[: len(owner)].tolist()), np.int64)
    left = np.where(real, count[owner] - rank, 0)
    order = order[left[order] >= whole]
    if not len(order):
        return np.zeros((0, 2), np.int64)
    same = np.ones(len(order) - 1, bool)
    for k in range(whole):
        same &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    run = np.cumsum(np.r_[True, ~same]) - 1
    w = np.array(weights, np.int64)
    heavy = np.bincount(run, w[owner[order]])[run] >= 2
    order, run = order[heavy], run[heavy]
    found = []
    hashes, middle = Hashes(data), whole * block
    alone = np.bincount(run)[run] == 1  # one context of weight two or more: all its windows repeat
    for d in range(block):
        start = at[order] - d
        o = owner[order]
        ok = (start >= begin[o]) & (start + length <= begin[o] + sizes[o])
        plain = ok & alone
        found.append(np.stack([o[plain], start[plain] - begin[o[plain]]], 1))
        ok &= ~alone
        s, o, r = start[ok], o[ok], run[ok]
        if not len(s):
            continue
        # a run shares its whole blocks, so only the bytes before and behind them can differ
        key = _mixed(hashes.of(s, s + d) * _U(3) + _mixed(hashes.of(s + d + middle, s + length))) ^ _mixed(r.astype(_U) + _U(1))
        by = np.argsort(key)
        s, o, key = s[by], o[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        first = s[np.flatnonzero(new)[group]]
        for lo, size in ((0, d), (d + middle, length - d - middle)):  # equal hashes are held against the bytes
            view = sliding_window_view(data, max(1, size))
            if size and not all((view[s[k : k + 50_000] + lo] == view[first[k : k + 50_000] + lo]).all() for k in range(0, len(s), 50_000)):
                seen: dict[bytes, int] = {}  # unequal windows share a hash: go by the bytes alone
                group = np.array([seen.setdefault(data[x : x + length].tobytes(), len(seen)) for x in s.tolist()])
                break
        twice = np.bincount(group, w[o])[group] >= 2
        found.append(np.stack([o[twice], s[twice] - begin[o[twice]]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _pieces(texts: list[bytes], length: int, size: int = PIECE) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Texts in lots of about ``size`` bytes: their places in the list, bytes, and where these begin in the text.

    A window begins in one piece only, so a context at a cut falls into two, which changes no window.
    """
    which, parts, offsets, held = [], [], [], 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, size):
            part = t[at : at + size + length - 1]
            which.append(k), parts.append(part), offsets.append(at)
            held += len(part)
            if held >= size:
                yield which, parts, offsets
                which, parts, offsets, held = [], [], [], 0
    if parts:
        yield which, parts, offsets


def _context_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """key, anchor, context, a (first window) and shape (last window and anchor, from a) of every context.

    A context that occurs in a text again, as in repetitive texts, gives one row with the other places in ``more``. Of equal texts in one task the first two are enough, as a third can make nothing repeat that does not already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                raw = []
                for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                    times = seen[k] = seen.get(k, 0) + 1
                    raw.append(t.encode() if times <= 2 else b"")
                if len(seen) > 300_000:
                    seen.clear()
                for which, parts, offsets in _pieces(raw, length):
                    t, anchor, context, a, b, p = contexts(parts, length, gram)
                    if not len(t):
                        continue
                    text, shape = np.array(which, np.int64)[t], (b - a) << 16 | (p - a)
                    a = a + np.array(offsets, np.int64)[t]
                    order = np.lexsort((a, context, anchor, text))
                    text, anchor, context, a, shape = (x[order] for x in (text, anchor, context, a, shape))
                    new = np.r_[True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]
                    first = np.flatnonzero(new)
                    size = np.diff(np.r_[first, len(a)])
                    more: list = [None] * len(first)
                    for k in np.flatnonzero(size > 1).tolist():
                        more[k] = a[first[k] + 1 : first[k] + size[k]].tolist()
                    keys = batch.column("key").take(pa.array(text[first]))
                    columns = [keys, pa.array(anchor[first]), pa.array(context[first]), pa.array(a[first].astype(np.int32)), pa.array(shape[first].astype(np.int32)), pa.array(more, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "anchor", "context", "a", "shape", "more"])

    return arrow_map(rows.select("key", "text"), run, "key binary, anchor bigint, context bigint, a int, shape int, more array<int>")


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", symbols: int = 200_000, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left) of each row of ``docs``.

    Texts are UTF-8 bytes, null ones empty; matches never cross texts. A byte goes if a string of ``length`` bytes
    covers it that also starts anywhere else, in the same text or in another row, as the input has them. Rows that
    repeat an id and text are copies of each other, so of ``length`` bytes or more they are removed whole; shorter texts stay. An
    empty table gives an empty one; other columns are left out. Contexts of one anchor that differ meet in one task, but for anchors
    of more than about ``hot`` contexts.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = _context_rows(rows.filter(F.octet_length("text") >= length), length, gram)
    times = F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0))
    of_anchor = Window.partitionBy("anchor")
    often = found.withColumn("n", F.sum(times).over(of_anchor)).withColumn("least", F.min("context").over(of_anchor)).withColumn("most", F.max("context").over(of_anchor))
    # of d different hashes the least and the greatest lie about one d-th of the range from its ends
    low = min(-(1 << 63) + (1 << 64) // hot, (1 << 63) - 1)
    many = (F.col("n") > hot) & (F.col("least") <= low) & (F.col("most") >= -low - 1)
    candidates = written(often.filter("n > 1").withColumn("hot", many).drop("n", "least", "most"))
    # the same exchange of the texts by key serves here and for the result
    dealt = rows.select("key", "doc_id", "text")

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        """Anchors, contexts, weights, offsets and bytes of the contexts of a few texts at a time."""
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out = [[], [], [], [], []]
                for t, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
                    raw = t.encode()
                    for q in parts:
                        a, last, offset = q["a"], q["shape"] >> 16, q["shape"] & 0xFFFF
                        for column, v in zip(out, (q["anchor"], q["context"], min(q["weight"], 2), offset, raw[a : a + last + length])):
                            column.append(v)
                yield out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["anchor", "context", "weight", "offset", "bytes"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in lots(batches):
            for at in range(0, len(out[0]), 128):
                anchor, context, weight, _, raw = (c[at : at + 128] for c in out)
                times = [len(r) - length + 1 for r in raw]
                digests = [hashlib.md5(r[j : j + length]).digest() for r, n in zip(raw, times) for j in range(n)]
                same = [pa.array(np.repeat(np.array(c, np.int64), times)) for c in (anchor, context, weight)]
                number = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in times]))
                yield pa.RecordBatch.from_arrays([*same, number, pa.array(digests, pa.binary())], ["anchor", "context", "weight", "number", "window"])

    def cut_from_texts(contexts: DataFrame, function, schema: str) -> DataFrame:
        """``function`` over the texts, each different context being a part of one text that holds it."""
        groups = contexts.groupBy("anchor", "context").agg(F.sum(times).alias("weight"), F.min(F.struct("key", "a", "shape")).alias("r"))
        wanted = groups.select(F.col("r.key").alias("key"), F.struct("anchor", "context", "weight", F.col("r.a").alias("a"), F.col("r.shape").alias("shape")).alias("part"))
        wanted = wanted.groupBy("key").agg(F.collect_list("part").alias("parts"))
        one = dealt.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("parts").alias("parts"), F.min("doc_id").alias("doc_id"))
        return arrow_map(one.select("text", "parts", "doc_id"), function, schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            hits = repeated_windows([h[4] for h in held], [h[3] for h in held], [h[2] for h in held], length)
            hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
            at, first = np.unique(hits[:, 0], return_index=True)
            runs = np.split(hits[:, 1], first[1:]) if len(at) else []
            made = [(held[k][0], held[k][1], [(lo, hi) for lo, hi in _ranges(r)]) for k, r in zip(at.tolist(), runs)]
            windows = pa.array([[{"lo": lo, "hi": hi} for lo, hi in m[2]] for m in made], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), windows], ["anchor", "context", "windows"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "weight", "offset", "bytes"))):
                if size > symbols and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // BLOCK + 1
        if held:
            yield done()

    pieces = cut_from_texts(candidates.filter("NOT hot"), cut, "anchor bigint, context bigint, weight bigint, offset int, bytes binary")
    sorted_pieces = pieces.repartition("anchor").sortWithinPartitions("anchor", "context")
    repeats = arrow_map(sorted_pieces, search, "anchor bigint, context bigint, windows array<struct<lo:int,hi:int>>")
    if not candidates.filter("hot").isEmpty():
        single = cut_from_texts(candidates.filter("hot"), windows, "anchor bigint, context bigint, weight bigint, number int, window binary")
        repeats = repeats.unionByName(_repeats_one_by_one(single))
    again = repeats.select(fresh_key_long("anchor").alias("anchor"), "context", "windows")
    places = candidates.withColumn("a", F.explode(F.concat(F.array("a"), F.coalesce("more", F.array().cast("array<int>")))))
    back = places.join(again, ["anchor", "context"]).select("key", F.explode("windows").alias("w"), "a").select("key", (F.col("a") + F.col("w.lo")).alias("lo"), (F.col("a") + F.col("w.hi")).alias("hi"))
    marks = back.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for t, windows in zip(batch.column("text"), batch.column("windows")):
                    raw, pos, kept, spans, gone = (t.as_py() or "").encode(), 0, [], 0, 0
                    if windows.is_valid:  # there may be very many; they stay Arrow arrays
                        lo, hi = (windows.values.field(k).to_numpy() for k in ("lo", "hi"))
                        for start, end in _united(lo.astype(np.int64), hi.astype(np.int64) + length):
                            kept.append(raw[pos:start])
                            pos, spans, gone = end, spans + 1, gone + end - start
                    kept.append(raw[pos:])
                    out.append((len(raw), gone, spans, b"".join(kept)))
                columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    final = dealt.join(marks, "key", "left").select("doc_id", "text", "windows")
    return arrow_map(final, keep, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _repeats_one_by_one(windows: DataFrame) -> DataFrame:
    """anchor, context and windows (runs of repeated ones), for anchors of any frequency.

    Each window is a row with its digest, and digests are counted by a partial aggregate, so no task holds the contexts
    of an anchor, and a window that is repeated very often is a single row of each task.
    """
    twice = windows.groupBy("window").agg(F.sum("weight").alias("n")).filter("n > 1").select(F.concat("window", F.lit(b"")).alias("window"))
    found = windows.join(twice, "window", "left_semi").groupBy("anchor", "context").agg(F.sort_array(F.collect_set("number")).alias("at"))
    found = found.withColumn("lo", F.array_except("at", F.transform("at", lambda x: x + 1))).withColumn("hi", F.array_except("at", F.transform("at", lambda x: x - 1)))
    return found.select("anchor", "context", F.arrays_zip("lo", "hi").alias("windows"))


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    s = np.unique(starts)
    cut = np.flatnonzero(np.diff(s) > 1) + 1
    return [(int(g[0]), int(g[-1])) for g in np.split(s, cut)]


def _united(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal spans."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > reach[:-1]]
    return list(zip(lo[new].tolist(), reach[np.r_[new[1:], True]].tolist()))
