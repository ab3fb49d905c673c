"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over all documents.
2. Passages (windows of words) become TF-IDF vectors; a randomised SVD, whose product with the passage matrix is
   computed on the executors, gives a latent space. It is fitted on the passages of all documents and on all benchmark
   items; every passage of every document is then searched in it.
3. Passages whose latent product with an item is a high enough share of the item's squared norm are candidates. That is
   the squared cosine of the item with the passage's part in the item's words: words of the host that are not the
   item's have no say, nor has the number of documents. Passages for an item are long enough for any stretch that step
   4 compares to lie in one of them.
4. A candidate counts as a leak if the longest common subsequence of words with the item, within a stretch of the
   document not much longer than the item, covers enough of the item, and enough of the item's answer words, those
   that carry most of its weight, occur there.

Items of a benchmark have little in common, so the latent space of a block of items has a few more dimensions than the
block has items, and items weigh more than passages in its fit: then none of them is lost in it. Blocks are of a fixed
size and a fixed number of them is broadcast for a pass over the documents, so what is broadcast is bounded.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map, drop_written, written

#: Words of half a passage that the SVD is fitted on; passages start at every half. Those searched depend on the length of the item.
STRIDE = 20
#: Words whose vectors are summed first, and words that are searched at a time.
GRAIN, PIECE = 4, 8192
#: Items that share a latent space, blocks that are searched in one pass.
BLOCK, BLOCKS = 256, 8
#: Words whose products for the SVD are taken at a time.
SPAN = 16_000
#: Rows of a group that are added in step with those of all other groups; the rest are by group.
ROUNDS = 16
#: Rows of a block's sums for the SVD that are merged at a time, and tasks that merge them.
SLICE, PARTS = 128, 32
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))
LEAK = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or "").lower().encode().translate(_TABLE).split()


def lcs_length(pattern: list, masks: dict, stretch: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: ``masks`` has the places of each word of the pattern."""
    full = (1 << len(pattern)) - 1
    v = full
    for w in stretch:
        m = masks.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


@dataclass
class Block:
    """A latent space and the items in it. Words have the places of the index's vocabulary."""

    item_ids: list[int]
    items: list[list[int]]
    basis: np.ndarray = field(default=None)  # place in ``local`` x rank, times the idf of the word
    local: np.ndarray = field(default=None)  # of each word of the vocabulary the row of the basis, the last one for all others
    latent: np.ndarray = field(default=None)  # item x rank, divided by the item's squared norm
    masks: list[dict[int, int]] = field(default=None)
    answers: list[dict[int, float]] = field(default=None)

    def finish(self, vectors: np.ndarray, local: np.ndarray, idf: np.ndarray, share: float = 0.5) -> None:
        known = np.flatnonzero(local < len(vectors))
        scaled = vectors * idf[known[np.argsort(local[known])], None]
        self.local, self.basis = local, np.vstack([scaled, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
        rows, self.masks, self.answers = [], [], []
        for item in self.items:
            masks: dict[int, int] = {}
            for k, w in enumerate(item):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
            norm2 = sum(float(idf[w] ** 2) * m.bit_count() ** 2 for w, m in masks.items())
            rows.append(self.basis[local[item]].sum(0) / max(1e-9, norm2))
            weight = {w: float(idf[w] ** 2) for w in masks}
            total, got, answer = sum(weight.values()), 0.0, {}
            for w in sorted(weight, key=lambda w: (-weight[w], w)):
                if got >= share * total and len(answer) >= 3:
                    break
                answer[w] = weight[w]
                got += weight[w]
            self.answers.append(answer)
        self.latent = np.array(rows, np.float32).reshape(len(self.items), -1)


@dataclass
class Index:
    """What one pass needs; its size depends on the benchmark alone, and is bounded."""

    place: dict[bytes, int]
    idf: np.ndarray  # of each word of the vocabulary, last a zero for all other words
    blocks: list[Block]


@dataclass(frozen=True)
class Rule:
    """Thresholds of the search."""

    cosine: float = 0.35
    lcs: float = 0.6
    #: Share of the answer words' weight at the least ``lcs``; it falls by as much as the stretch covers more, to ``least``.
    answer: float = 0.5
    least: float = 0.2
    #: Length of the stretch that is compared, in lengths of the item.
    stretch: float = 1.6


def document_frequencies(docs: DataFrame, place: dict[bytes, int], text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each word of ``place`` occurs, and how many documents there are."""
    n = len(place)
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, known = np.zeros(n + 1, np.int64), 0, shared.value
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0):
                counts[np.unique(_lookup(words_of(t.as_py()), known, n))] += 1
        counts[n] = rows
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts[ids], pa.int64())], ["id", "n"])

    # one row a word at most, so what is collected is as large as the benchmark's vocabulary
    found = arrow_map(docs.select(text), run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n + 1, np.int64)
    for r in found:
        out[r["id"]] = r["n"]
    return out[:-1], int(out[-1])


def stretch_grid(n: int, rule: Rule) -> tuple[int, int]:
    """Length of the stretches that are compared with an item of ``n`` words, and the distance of their starts."""
    return max(3, int(n * rule.stretch)), max(1, n // 4)


def _stride(n: int, rule: Rule) -> int:
    """A quarter of the passages for an item of ``n`` words and the distance of their starts: three quarters hold a stretch."""
    need, size = -(-stretch_grid(n, rule)[0] // 3), 2 * GRAIN
    while size < need:  # 8, 12, 16, 24, 32, ...
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def _lookup(words: list[bytes], place: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter(map(place.get, words, repeat(other)), np.int32, len(words))


def _pieces(texts: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in groups of some SPAN words; long ones in pieces, each with both halves of its passages."""
    group, words = [], 0
    for ids in texts:
        passages = max(1, -(-len(ids) // STRIDE) - 1)
        for lo in range(0, passages, SPAN // STRIDE) if len(ids) else ():
            piece = ids[lo * STRIDE : (min(lo + SPAN // STRIDE, passages) + 1) * STRIDE]
            group.append(piece)
            words += len(piece)
            if words >= SPAN:
                yield group
                group, words = [], 0
    if group:
        yield group


def _summed(x: np.ndarray, rows: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x[rows] over groups that start at ``new``, and which group each is of: as reduceat, but by whole rows."""
    sizes = np.diff(np.r_[new, len(rows)])
    which = np.argsort(-sizes, kind="stable")
    first, sizes = new[which], sizes[which]
    more = [int(n) for n in np.searchsorted(-sizes, -np.arange(1, ROUNDS + 1))]  # groups of more than 1, 2, ... rows
    out = np.take(x, rows[first], axis=0)
    for k, n in enumerate(more[:-1], 1):
        if not n:
            break
        out[:n] += np.take(x, rows[first[:n] + k], axis=0)
    for k in range(more[-1]):
        out[k] += np.take(x, rows[first[k] + ROUNDS : first[k] + sizes[k]], axis=0).sum(0)
    return out, which


def add_products(out: list[np.ndarray], texts: Iterable[np.ndarray], idf: np.ndarray, local: list[np.ndarray], factors: list[np.ndarray]) -> None:
    """Adds A'(A X) to each block's matrix, A being the TF-IDF passages of ``texts`` in the block's words; X and the sums lack the idf.

    A passage is two halves of STRIDE words, so words are summed by half, before and after the product.
    """
    for group in _pieces(texts):
        ids, sizes = np.concatenate(group), np.array([len(p) for p in group])
        halves = -(-sizes // STRIDE)
        base, m = np.cumsum(halves) - halves, int(halves.sum())
        half = np.repeat(base, sizes) + (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STRIDE
        joined = np.ones(m, bool)  # with the half that follows
        joined[base + halves - 1] = False
        norm = np.bincount(half, idf[ids] ** 2, m)
        norm[:-1] += norm[1:] * joined[:-1]
        starts = joined.copy()
        starts[base[halves == 1]] = True
        factor = np.where(starts & (norm > 0), 1 / np.maximum(norm, 1e-30), 0.0).astype(np.float32)[:, None]
        joined = joined[:-1, None].astype(np.float32)
        for total, place, x in zip(out, local, factors):
            rows = place[ids]
            inside = np.flatnonzero(rows < len(x))
            if not len(inside):
                continue
            rows, h = rows[inside], half[inside]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            part, (sums, which) = np.zeros((m, x.shape[1]), np.float32), _summed(x, rows, new)
            part[h[new[which]]] = sums
            part[:-1] += part[1:] * joined
            part *= factor
            part[1:] += part[:-1] * joined
            order = np.argsort(rows, kind="stable")
            rows, h = rows[order], h[order]
            new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sums, which = _summed(part, h, new)
            total[rows[new[which]]] += sums


def randomised_svd(docs: DataFrame, n: int, place: dict[bytes, int], idf: np.ndarray, local: list[np.ndarray], items: list[list[list[int]]], extra: int, seed: int = 11, text: str = "text", weight: float = 10.0, worth: int = 300) -> list[np.ndarray]:
    """For each block the leading right singular vectors (words of the block x rank) of the TF-IDF passages of all ``docs`` and of its items.

    One distributed product A'(A X) over every passage of all ``n`` documents, of a random X, for all blocks at once; the
    passages' ``extra`` leading directions are those of the approximation of A'A that is exact on X (Nystrom's). The space
    is then sought among these and the items, whose product is exact. Items count ``weight`` times a passage; where there
    are more documents than ``worth``, their passages count as much all together as those of that many, so that the items
    keep their weight in a corpus of any size.
    """
    session, other = docs.sparkSession.sparkContext, len(idf) - 1
    random, factors, own_idf = np.random.default_rng(seed), [], []
    for where in local:
        v = int(where.max())  # the row of all other words
        known = np.flatnonzero(where < v)
        own_idf.append(idf[known[np.argsort(where[known])]][:, None])
        factors.append(np.linalg.qr(random.normal(size=(v, min(v, extra + 8))))[0])
    scaled = [(i * x).astype(np.float32) for i, x in zip(own_idf, factors)]
    shared = session.broadcast((place, idf, local, scaled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, local, factors = shared.value
        out = [np.zeros(x.shape) for x in factors]
        for batch in batches:
            add_products(out, (_lookup(words_of(t.as_py()), place, other) for t in batch.column(0)), idf, local, factors)
        for k, total in enumerate(out):
            for lo in range(0, len(total), SLICE):
                if (rows := total[lo : lo + SLICE]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lo], pa.int32()), pa.array([rows.astype(np.float32).tobytes()], pa.binary())], ["block", "lo", "z"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, lo, z in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.frombuffer(z, np.float32)
                sums[k, lo] = sums[k, lo] + rows if (k, lo) in sums else rows.astype(float)
        for (k, lo), rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lo], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["block", "lo", "z"])

    # merged by slices, so neither a task nor the driver takes the matrices of all tasks
    schema, sums = "block int, lo int, z binary", [np.zeros(x.shape) for x in factors]
    merged = written(arrow_map(arrow_map(docs.select(text), run, schema).repartition(PARTS, "block", "lo"), merge, schema))
    for r in merged.toLocalIterator():
        rows = np.frombuffer(r["z"]).reshape(-1, factors[r["block"]].shape[1])
        sums[r["block"]][r["lo"] : r["lo"] + len(rows)] += rows
    drop_written(merged)
    shared.unpersist()

    out = []
    for where, own, x, i, y in zip(local, items, factors, own_idf, sums):
        y *= i * min(1.0, worth / max(1, n))
        values, vectors = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
        good = values > 1e-6 * values[-1]
        leading = y @ (vectors[:, good] / np.sqrt(values[good]))  # times its transpose it is A'A
        whole = np.zeros((len(y), len(own)))
        for k, item in enumerate(own):
            np.add.at(whole[:, k], where[item], idf[item])
        q = np.linalg.qr(np.hstack([whole, leading]))[0]
        mine = np.zeros(q.shape)
        add_products([mine], (np.array(item) for item in own), idf, [where], [(i * q).astype(np.float32)])
        m, part = weight**2 * q.T @ (i * mine), q.T @ leading
        values, vectors = np.linalg.eigh((m + m.T) / 2 + part @ part.T)
        out.append((q @ vectors[:, ::-1][:, : len(own) + extra]).astype(np.float32))
    return out


def build_indexes(docs: DataFrame, benchmark: DataFrame, extra_rank: int = 32, block: int = BLOCK, blocks: int = BLOCKS, text: str = "text") -> Iterator[Index]:
    """Indexes of up to ``blocks`` blocks of up to ``block`` items. Items without words are passed over."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    ids, items = [], []
    for r in rows.toLocalIterator():  # of the benchmark, a pass's items at a time
        if words := words_of(r["text"]):
            ids.append(r["item_id"]), items.append(words)
        if len(items) == block * blocks:
            yield _index(docs, ids, items, extra_rank, block, text)
            ids, items = [], []
    if items:
        yield _index(docs, ids, items, extra_rank, block, text)


def _index(docs: DataFrame, ids: list[int], items: list[list[bytes]], extra_rank: int, size: int, text: str) -> Index:
    place = {w: k for k, w in enumerate(sorted({w for item in items for w in item}))}
    df, n = document_frequencies(docs, place, text)
    idf = np.r_[np.maximum(np.log((n + 2) / (df + 1)), 0.01), 0.0]
    index, locals_ = Index(place, idf, []), []
    for lo in range(0, len(items), size):
        coded = [[place[w] for w in item] for item in items[lo : lo + size]]
        used = sorted({w for item in coded for w in item})
        local = np.full(len(idf), len(used), np.int32)
        local[used] = np.arange(len(used))
        index.blocks.append(Block(ids[lo : lo + size], coded))
        locals_.append(local)
    spaces = randomised_svd(docs, n, place, idf, locals_, [b.items for b in index.blocks], extra_rank, text=text)
    for made, local, vectors in zip(index.blocks, locals_, spaces):
        made.finish(vectors, local, idf)
    return index


class Searcher:
    """Finds leaks of an index's items in whole texts."""

    def __init__(self, index: Index, rule: Rule):
        self.index, self.rule, self.other = index, rule, len(index.place)
        self.strides: list[list[tuple[int, np.ndarray, slice]]] = []  # of each block: stride, its items, their columns
        self.shares: list[np.ndarray] = []  # of each block: latent product of each word with each item, items by stride
        self.member: list[np.ndarray] = []  # of each block: item x word, whether the item has it
        for block in index.blocks:
            sizes = np.array([_stride(len(item), rule) for item in block.items])
            order, ends = np.argsort(sizes, kind="stable"), np.cumsum([int((sizes == c).sum()) for c in np.unique(sizes)])
            self.strides.append([(int(c), np.flatnonzero(sizes == c), slice(int(e - (sizes == c).sum()), int(e))) for c, e in zip(np.unique(sizes), ends)])
            self.shares.append(np.ascontiguousarray(block.basis @ block.latent[order].T))
            member = np.zeros((len(block.items), len(block.basis)), bool)
            for k, item in enumerate(block.items):
                member[k, block.local[item]] = True
            member[:, -1] = False
            self.member.append(member)

    def __call__(self, text: str | None) -> list[dict]:
        x = self.index
        words = words_of(text)
        if not words or not x.blocks:
            return []
        ids = _lookup(words, x.place, self.other)
        coded, best = None, {}
        for which, block in enumerate(x.blocks):
            rows = block.local[ids]
            for k, lo, hi, share in zip(*(z.tolist() for z in self.regions(which, rows))):
                places = np.flatnonzero(self.member[which][k][rows[lo:hi]])
                if len(places) < self.rule.lcs * len(block.items[k]):
                    continue
                coded = ids.tolist() if coded is None else coded
                found, at = self.check(block, coded, lo, hi, k, (places + lo).tolist()), block.item_ids[k]
                if found and found[0] > best.get(at, {"lcs": -1.0})["lcs"]:
                    best[at] = {"item_id": at, "cosine": min(1.0, share) ** 0.5, "lcs": found[0], "answer": found[1]}
        return [best[k] for k in sorted(best)]

    def regions(self, which: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Items, starts, ends and highest shares of the candidates; those of an item that overlap are one.

        The products of the words are summed over grains, strides and passages, which have four strides.
        """
        least, n, strides, table = self.rule.cosine**2, len(rows), self.strides[which], self.shares[which]
        longest = 4 * strides[-1][0]
        piece = max(PIECE, -(-longest // GRAIN) * GRAIN)
        found = []
        for lo in range(0, n, piece):
            near = rows[lo : lo + piece + longest]
            padded = np.full(-(-len(near) // GRAIN) * GRAIN, len(table) - 1, rows.dtype)
            padded[: len(near)] = near
            grains = np.take(table, padded[0::GRAIN], axis=0)
            for k in range(1, GRAIN):
                grains += np.take(table, padded[k::GRAIN], axis=0)
            for c, items, columns in strides:
                first = -(-lo // c) * c
                count, k = -(-(min(lo + piece, n) - first) // c), c // GRAIN
                if count <= 0:
                    continue
                own, sums = grains[(first - lo) // GRAIN :, columns], np.zeros((count + 3, len(items)), np.float32)
                for j in range(k):
                    part = own[j::k][: count + 3]
                    sums[: len(part)] += part
                shares = sums[:-3] + sums[1:-2]
                shares += sums[2:-1]
                shares += sums[3:]
                if shares.max() >= least:
                    w, k = np.nonzero(shares >= least)
                    at = first + w * c
                    found.append((items[k], at, np.minimum(at + 4 * c, n), shares[w, k]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        item, at, end, share = (np.concatenate(z) for z in zip(*found))
        order = np.lexsort((at, item))
        item, at, end, share = item[order], at[order], end[order], share[order]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (at[1:] > end[:-1])])
        return item[new], at[new], end[np.r_[new[1:], len(item)] - 1], np.maximum.reduceat(share, new)

    def check(self, block: Block, words: list[int], lo: int, hi: int, k: int, places: list[int]) -> tuple[float, float] | None:
        """Shares of the item that the best stretch inside words[lo:hi] covers in order, and of its answer words' weight.

        ``places`` are those of the item's words there. Stretches start at multiples of a step from the start of the text, so they do not depend on the region.
        """
        rule, item, masks, answer = self.rule, block.items[k], block.masks[k], block.answers[k]
        n, total = len(item), max(1e-9, sum(answer.values()))
        length, step = stretch_grid(n, rule)
        if sum(answer.get(w, 0.0) for w in {words[j] for j in places}) < rule.least * total:
            return None
        best = None
        for at in range(-(-lo // step) * step, max(1, len(words) - length + step), step):
            end = min(at + length, len(words))
            if end > hi:
                break
            a, b = bisect_left(places, at), bisect_left(places, end)
            if b - a < rule.lcs * n:
                continue
            stretch = [words[j] for j in places[a:b]]
            share = lcs_length(item, masks, stretch) / n
            if share >= rule.lcs and (best is None or share > best[0]):
                have = sum(answer.get(w, 0.0) for w in set(stretch)) / total
                if have >= max(rule.least, rule.answer - (share - rule.lcs)):
                    best = (share, have)
        return best


def find_leaks(docs: DataFrame, index: Index, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """``docs`` with leaks: the items found in each row's text, with cosine, lcs and answer share, best stretch each.

    A null or empty text has none. Rows are independent: repeated rows have equal leaks, an empty table gives an empty
    one. A column named leaks is replaced. One pass without a shuffle; texts are searched whole.
    """
    docs = docs.drop("leaks")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(shared.value, rule)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([search(t.as_py()) for t in batch.column(text)], kind)], [*batch.schema.names, "leaks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, leaks {LEAK}")


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """A row (doc_id, item_id, cosine, lcs, answer) for each document and benchmark item found in it.

    Null and empty texts have none, and items without an id or words are passed over. Items that share an id are searched
    apart, and the best of them counts. Of stretches that tie, the first one counts. Repeated rows each have their own rows
    here, and an empty table or benchmark gives none. Other columns are left out; texts of any length are searched whole.
    """
    out = None
    for index in build_indexes(docs, benchmark, text=text, **fit):
        found = find_leaks(docs.select(doc_id, text), index, rule, text).select(doc_id, F.explode("leaks").alias("leak")).select(doc_id, "leak.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.select(doc_id, F.explode(F.lit(None).cast(LEAK)).alias("leak")).select(doc_id, "leak.*")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text: str = "text", **fit) -> DataFrame:
    """``docs`` without the rows that leak an item, as ``leaks`` finds them; rows with a null or empty text stay.

    All columns stay but one named leaks. Repeated rows stay or go alike; an empty table gives an empty one.
    """
    out = docs
    for index in build_indexes(docs, benchmark, text=text, **fit):
        out = find_leaks(out, index, rule, text).filter(F.size("leaks") == 0).drop("leaks")
    return out
