"""Token counts of a SentencePiece BPE vocabulary by rank-synchronous array merging.

A text is escaped as the library escapes it (a blank becomes the mark, one mark goes in front) and cut into
pre-tokens at places no piece of the vocabulary crosses; long ones, as of texts without blanks, are cut further where no
piece that occurs there lies across. Pre-tokens not seen before are merged together, as
ragged numpy arrays of symbol ids: in each round every sequence merges its pair of lowest rank (the leftmost of
equals), all sequences at once, until none has a pair left. The symbols that survive are counted; characters
outside the vocabulary count their UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map

MARK = "▁"
NO_PAIR = np.iinfo(np.int64).max
#: Pre-tokens longer than this are cut wherever no piece of the vocabulary lies across.
LONG = 48
_BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceVocabulary:
    """Ranks of the pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  A ") != f"{MARK}ﬁ{MARK}{MARK}A{MARK}":
            raise ValueError(f"{path}: only models that keep texts as they are, with a mark in front, are counted")
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        normal = [i for i in range(model.get_piece_size()) if not special(i)]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path}: a piece holds a mark after another character")
        # equal scores share a rank, so that the leftmost of them goes first
        rank_of = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ids: dict[str, int] = {}
        for p in pieces:
            self.ids[p] = len(self.ids)
        self.char_ids = {p: i for p, i in self.ids.items() if len(p) == 1}
        left, right, rank, made = [], [], [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(rank_of[pieces[p]]), made.append(i)
        self.base = len(self.ids) + 2  # the last two: a character outside the vocabulary, the end of a sequence
        self.outside, self.end = self.base - 2, self.base - 1
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array(rank, np.int64)[order]
        self.pair_made = np.array(made, np.int64)[order]
        joined = set("".join(p for p in self.ids if len(p) > 1))
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        #: A pre-token: marks and what follows up to the next mark; characters that never join stand alone.
        body = f"[^{MARK}{alone}]"
        self.split = re.compile(f"{MARK}+{body}*|{body}+" + (f"|[{alone}]" if alone else ""))

        # hashes of the pieces by length; two texts that share one only leave a place uncut
        self.longest, self.hashes = max(map(len, self.ids)), {}
        for n in range(2, self.longest + 1):
            same = [p for p in self.ids if len(p) == n]
            points = np.array([[ord(c) for c in p] for p in same], np.uint64).reshape(len(same), n) + np.uint64(1)
            h = points[:, 0]
            for k in range(1, n):
                h = h * _BASE + points[:, k]
            self.hashes[n] = np.sort(h)

        # pieces of marks alone share one rank, so a run of marks closes the longest of them again and again
        # from the left; where that holds, long runs are cut beforehand
        marks = [p for p in self.ids if set(p) == {MARK}]
        self.run = max(map(len, marks), default=0)
        trial = self.count([MARK * n for n in range(2 * self.run, 6 * self.run)])
        if len({pieces[p] for p in marks if len(p) > 1}) != 1 or (trial[self.run :] != trial[: -self.run] + 1).any():
            self.run = 0

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        out = self.split.findall(marked)
        long = 4 * self.run
        if long and MARK * long in marked:
            out = [part for w in out for part in self.cut_run(w)]
        if len(max(out, key=len)) > LONG:
            out = [part for w in out for part in self.cut_free(w)]
        return out

    def cut_free(self, word: str) -> list[str]:
        """A long word, cut wherever no piece that occurs in it lies across, as then no merge can either."""
        if len(word) <= LONG:
            return [word]
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(points)
        change, h = np.zeros(n + 1, np.int32), points
        for size in range(2, min(n, self.longest) + 1):
            h = h[:-1] * _BASE + points[size - 1 :]
            keys = self.hashes[size]
            if len(keys):
                start = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)
                change[start + 1] += 1
                change[start + size] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(change)[1:n] == 0) + 1).tolist(), n]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def cut_run(self, word: str) -> list[str]:
        """A long run of marks as pieces of full length from the left, and the rest with what follows."""
        n = len(word) - len(word.lstrip(MARK))
        if not self.run or n <= 4 * self.run:
            return [word]
        full = n // self.run - 2
        return [MARK * self.run] * full + [word[full * self.run :]]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol it makes; NO_PAIR where the vocabulary has none."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_rank[at], NO_PAIR), self.pair_made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word, all words merged at the same time."""
        total = np.zeros(len(words), np.int64)
        ids, flat, lengths = self.char_ids, [], []
        for k, word in enumerate(words):
            n = len(flat)
            for c in word:
                i = ids.get(c)
                if i is None:
                    total[k] += len(c.encode("utf-8", "surrogatepass")) - 1
                    i = self.outside
                flat.append(i)
            lengths.append(len(flat) - n)
        size = np.array(lengths, np.int64)
        total += size
        symbols = np.array(flat, np.int64)
        row = np.repeat(np.arange(len(words)), size)
        # a round looks only at sequences that still have a pair
        while len(symbols) > 1:
            same = row[:-1] == row[1:]
            rank, made = self.look_up(symbols[:-1], np.where(same, symbols[1:], self.end))
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(np.r_[rank, NO_PAIR], starts)
            group = np.cumsum(np.r_[True, ~same]) - 1
            at = np.flatnonzero((rank == lowest[group[:-1]]) & (rank != NO_PAIR))
            if not len(at):
                break
            at = self.at_once(at, group[at], symbols, row, rank, made)
            np.subtract.at(total, row[at], 1)
            symbols[at] = made[at]
            stay = lowest[group] != NO_PAIR
            stay[at + 1] = False
            symbols, row = symbols[stay], row[stay]
        return total

    def at_once(self, at: np.ndarray, group: np.ndarray, symbols: np.ndarray, row: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which of the pairs of lowest rank to merge in this round.

        The leftmost pair of each sequence always; further occurrences of the same pair too, without overlap,
        where no pair that the merges make on the way ranks as low, as then they are next in turn anyway.
        """
        first = np.r_[True, group[1:] != group[:-1]]
        if first.all():
            return at
        lead = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        same = (symbols[at] == symbols[lead]) & (symbols[at + 1] == symbols[lead + 1])
        at, group = at[same], group[same]
        follows = np.r_[False, (at[1:] == at[:-1] + 1) & (group[1:] == group[:-1])]
        run = np.flatnonzero(~follows)[np.cumsum(~follows) - 1]
        pick = (np.arange(len(at)) - run) % 2 == 0  # in "aaaa" every other pair
        at, group = at[pick], group[pick]
        first = np.r_[True, group[1:] != group[:-1]]
        # the left neighbour as merged so far, the right neighbour as it still is
        merged = symbols.copy()
        merged[at] = made[at]
        back = np.where(np.r_[False, at[1:] == at[:-1] + 2], at - 2, at - 1)
        left = np.where((at > 0) & (row[back] == row[at]), merged[back], self.end)
        ahead = np.minimum(at + 2, len(symbols) - 1)
        right = np.where((at + 2 < len(symbols)) & (row[ahead] == row[at]), symbols[ahead], self.end)
        low = np.minimum(self.look_up(left, made[at])[0], self.look_up(made[at], right)[0]) <= rank[at]
        unsafe = np.zeros(int(group.max()) + 1, bool)
        unsafe[group[low]] = True
        return at[first | ~unsafe[group]]


class TextCounter:
    """Counts whole texts; what a pre-token counts is kept for up to ``keep`` pre-tokens."""

    def __init__(self, vocabulary: PieceVocabulary, keep: int = 400_000):
        self.vocabulary, self.keep, self.known = vocabulary, keep, {}

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for lo in range(0, len(texts), 256):
            cut = [self.vocabulary.pre_tokens(t) for t in texts[lo : lo + 256]]
            if len(self.known) > self.keep:
                self.known.clear()
            new = list({w for words in cut for w in words if w not in self.known})
            new.sort(key=len)
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.known.update(zip(part, self.vocabulary.count(part).tolist()))
            get = self.known.__getitem__
            out += [sum(map(get, words)) for words in cut]
        return out


_counters: dict[str, TextCounter] = {}


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with n_bytes, n_tokens and over_limit (n_tokens > limit) of its text.

    One pass, no shuffle. A null text counts as empty: no bytes, no tokens. Texts of any length are counted
    whole; repeated rows each give a row; an empty table gives an empty one; other columns are left out.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(vocabulary) or _counters.setdefault(vocabulary, TextCounter(PieceVocabulary(vocabulary)))
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            n = counter.counts(texts)
            n_bytes = [len(t.encode()) for t in texts]
            columns = [batch.column(c) for c in keep] + [pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_bytes", "n_tokens", "over_limit"])

    source = df.select(*keep, F.col(text).alias("__text"))
    return arrow_map(source, run, f"{fields}, n_bytes bigint, n_tokens bigint, over_limit boolean")
