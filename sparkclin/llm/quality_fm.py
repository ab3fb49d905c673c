"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise term is scored in time linear in the features by
``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``. Words are hashed into a fixed number of places and weigh
1/sqrt of the distinct words; statistics of the whole text (lengths, shares of symbols, capitals, repeats) are put
into bins, one feature a bin. Training is on all labelled rows: their features are written in blocks, each step of L-BFGS
sums loss and gradient over all blocks on the executors, and the driver holds only the model, which has a fixed size and
goes to the executors as a broadcast. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map, drop_written, written

WORD_PLACES = 1 << 14
BINS = 12
#: Upper bounds of the bins of each statistic, in its own unit.
EDGES = {
    "words": [1, 3, 6, 10, 20, 50, 100, 200, 500, 1000, 5000],
    "characters": [10, 30, 60, 120, 250, 500, 1000, 2500, 5000, 10000, 50000],
    "word_length": [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 10, 15, 30],
    "symbols": [0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5],
    "capitals": [0.001, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7],
    "exclaimed": [0.001, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.9],
    "bars": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "distinct": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "stutter": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "equal_lines": [0.001, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.9],
    "digits": [0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5],
}
FEATURES = WORD_PLACES + BINS * len(EDGES)
#: Labelled rows whose features are summed at a time, such blocks in a file, and tasks that add the sums of all others.
ROWS, BLOCKS, PARTS = 512, 8, 8
#: Sums of a block are whole multiples of 1 / UNIT, so that the order in which blocks are added has no effect; and the most that one may be.
UNIT, MOST = float(1 << 24), 1e6
_UPPER, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=_{}[]"
_BOUNDS = [np.array(v) for v in EDGES.values()]


class Featurizer:
    """Texts to features; places of words are kept for up to ``keep`` words."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.place = keep, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode()
        words = raw.split()
        n, size = len(words), max(1, len(raw))
        distinct = set(words)
        if len(self.place) > self.keep:
            self.place.clear()
        for w in distinct.difference(self.place):
            self.place[w] = crc32(w) % WORD_PLACES
        less = lambda chars: (size - len(raw.translate(None, chars))) / size if raw else 0.0
        lines = raw.split(b"\n")
        stats = (
            n,
            len(text),
            len(text) / max(1, n),
            less(_SYMBOLS),
            less(_UPPER),
            raw.count(b"!!") / max(1, n),
            raw.count(b" | ") / max(1, n),
            len(distinct) / max(1, n),
            sum(map(eq, words, words[1:])) / max(1, n),
            1 - len(set(lines)) / len(lines),
            less(_DIGITS),
        )
        places = np.unique(np.fromiter(map(self.place.__getitem__, distinct), np.int32, len(distinct)))
        bins = np.array([WORD_PLACES + BINS * k + int(np.searchsorted(_BOUNDS[k], v)) for k, v in enumerate(stats)], np.int32)
        values = np.r_[np.full(len(places), 1 / np.sqrt(max(1, len(places))), np.float32), np.full(len(bins), 0.5, np.float32)]
        return np.r_[places, bins], values


@dataclass
class FactorisationMachine:
    """Parameters and training of the model."""

    factors: int = 8
    seed: int = 7
    bias: float = 0.0
    w: np.ndarray = field(default=None)
    v: np.ndarray = field(default=None)

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(ids, x), -30, 30))))

    def fit(self, objective: Callable[[FactorisationMachine], tuple[float, np.ndarray]], share: float, steps: int = 20, decay: float = 3e-5, memory: int = 8) -> FactorisationMachine:
        """L-BFGS on the mean log loss and ``decay`` / 2 times the squared norm of w and v.

        ``objective`` gives the mean loss and its gradient (bias, w, v in one array); ``share`` is that of label 1.
        """
        start = np.random.default_rng(self.seed).normal(0, 0.05, (FEATURES, self.factors))
        share = min(max(share, 0.01), 0.99)

        def value(p: np.ndarray) -> tuple[float, np.ndarray]:
            loss, g = objective(self._take(p))
            own = np.r_[0.0, p[1:]]
            return loss + decay / 2 * float(own @ own), g + decay * own

        p, pairs = np.r_[np.log(share / (1 - share)), np.zeros(FEATURES), start.ravel()], []
        loss, g = value(p)
        for _ in range(steps):
            if np.linalg.norm(g) < 1e-6:
                break
            d, shares = -g, []
            for s, y in reversed(pairs):
                shares.append((s @ d) / (s @ y))
                d = d - shares[-1] * y
            d = d * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / np.linalg.norm(g))
            for (s, y), a in zip(pairs, reversed(shares)):
                d = d + s * (a - (y @ d) / (s @ y))
            step, slope = 1.0, float(g @ d)
            new, new_g = value(p + d)
            while new > loss + 1e-4 * step * slope and step > 1e-3:
                step /= 2
                new, new_g = value(p + step * d)
            if new >= loss:
                break
            if (s := step * d) @ (y := new_g - g) > 1e-12:
                pairs = [*pairs[1 - memory :], (s, y)]
            p, loss, g = p + step * d, new, new_g
        return self._take(p)

    def constant(self, share: float) -> FactorisationMachine:
        """The model where there is nothing to tell apart."""
        share = min(max(share, 0.01), 0.99)
        return self._take(np.r_[np.log(share / (1 - share)), np.zeros(FEATURES * (1 + self.factors))])

    def _take(self, p: np.ndarray) -> FactorisationMachine:
        self.bias, self.w, self.v = float(p[0]), p[1 : 1 + FEATURES].astype(np.float32), p[1 + FEATURES :].reshape(FEATURES, -1).astype(np.float32)
        return self


def block_sums(words: np.ndarray, sizes: np.ndarray, bins: np.ndarray, labels: np.ndarray, bias: float, table: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Log loss of a block's rows, its derivative by the bias and, for each feature, the sums of g x s (s the factors' sums), g x and g x^2.

    ``words`` are the word features of all rows end to end, ``sizes`` of them a row, ``bins`` the other features, row by
    row; ``table`` has for each feature its factors, its w and the factors' squares. g is the derivative by the margin.
    """
    n, x = len(sizes), 1 / np.sqrt(np.maximum(1, sizes))[:, None]
    full = np.flatnonzero(sizes)
    of_words, of_bins = np.zeros((n, table.shape[1])), np.take(table, bins, axis=0).sum(1)
    if len(full):
        of_words[full] = np.add.reduceat(np.take(table, words, axis=0), (np.cumsum(sizes) - sizes)[full], axis=0)
    s = x * of_words[:, :-1] + 0.5 * of_bins[:, :-1]  # of the factors, and of w
    z = bias + s[:, -1] + 0.5 * ((s[:, :-1] ** 2).sum(1) - x[:, 0] ** 2 * of_words[:, -1] - 0.25 * of_bins[:, -1])
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)[:, None]
    rows, out = np.hstack([g * s[:, :-1], g]), np.zeros(table.shape)
    for ids, owner, made in (
        (words, np.repeat(np.arange(n), sizes), np.hstack([rows * x, g * x**2])),
        (bins.ravel(), np.repeat(np.arange(n), bins.shape[1]), np.hstack([rows * 0.5, g * 0.25])),
    ):
        if len(ids):
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            out[ids[new]] += np.add.reduceat(np.take(made, owner[order], axis=0), new, axis=0)
    return float((np.logaddexp(0, z) - labels * z).sum()), float(g.sum()), out


def held_out(doc_id: Column) -> Column:
    """True for the rows that training never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_blocks(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The features of all rows that have a label, in blocks of up to ROWS rows (n, good, labels, sizes, words, bins).

    Rows are dealt by a hash of their id and sorted within a block, so blocks do not depend on the plan. Texts are not
    shuffled, only features are.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    parts = max(1, -(-usable.count() // ROWS))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for batch in batches:
            made = [make(t.as_py() or "")[0].astype(np.uint16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, at, rows = len(EDGES), None, []

        def block() -> pa.RecordBatch:
            ids = [np.frombuffer(i, np.uint16) for _, i in rows]
            good = np.array([q for q, _ in rows], np.uint8)
            made = [good, np.array([len(i) - bins for i in ids], np.int32), np.concatenate([i[:-bins] for i in ids]), np.concatenate([i[-bins:] for i in ids])]
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([int(good.sum())], pa.int64()), *(pa.array([m.tobytes()], pa.binary()) for m in made)], ["n", "good", "labels", "sizes", "words", "bins"])

        for batch in batches:
            for part, quality, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "quality", "ids"))):
                if rows and (part != at or len(rows) == ROWS):
                    yield block()
                    rows.clear()
                at = part
                rows.append((quality, ids))
        if rows:
            yield block()

    known = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = arrow_map(known, featurize, "doc_id bigint, ids binary").join(usable, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    dealt = rows.repartition(-(-parts // BLOCKS), "part").sortWithinPartitions("part", "doc_id", "ids").select("part", "quality", "ids")
    return written(arrow_map(dealt, pack, "n bigint, good bigint, labels binary, sizes binary, words binary, bins binary"))


def mean_loss(blocks: DataFrame, n: int, model: FactorisationMachine) -> tuple[float, np.ndarray]:
    """The mean log loss over all ``n`` rows of ``blocks``, and its gradient (bias, w, v in one array)."""
    columns = [f"s{k}" for k in range(model.factors + 2)]
    shared = blocks.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, v = shared.value
        v = v.astype(float)
        table = np.hstack([v, w[:, None], (v**2).sum(1)[:, None]])
        sums = np.zeros((FEATURES + 1, table.shape[1]), np.int64)  # the last row for the loss and the bias
        for batch in batches:
            for values in zip(*(batch.column(c) for c in ("labels", "sizes", "words", "bins"))):
                labels, sizes, words, bins = (np.frombuffer(z.as_py(), kind) for z, kind in zip(values, (np.uint8, np.int32, np.uint16, np.uint16)))
                loss, g, out = block_sums(words, sizes, bins.reshape(len(sizes), -1), labels.astype(float), bias, table)
                sums[:-1] += np.rint(np.clip(out, -MOST, MOST) * UNIT).astype(np.int64)
                sums[-1, :2] += np.rint(np.clip([loss, g], -MOST, MOST) * UNIT).astype(np.int64)
        ids = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(r, pa.int64()) for r in sums[ids].T)], ["id", *columns])

    # one row a feature at most, so what is collected is as large as the model
    made = arrow_map(blocks.select("labels", "sizes", "words", "bins"), run, ", ".join(["id int", *(f"{c} bigint" for c in columns)]))
    got = made.repartition(PARTS, "id").groupBy("id").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    shared.destroy()
    sums = np.zeros((FEATURES + 1, len(columns)))
    sums[got["id"].to_numpy()] = np.stack([got[c].to_numpy() for c in columns], axis=1) / (UNIT * n)
    by_v = sums[:-1, :-2] - model.v * sums[:-1, -1:]
    return float(sums[-1, 0]), np.r_[sums[-1, 1], sums[:-1, -2], by_v.ravel()]


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> FactorisationMachine:
    """Fits on all labelled rows.

    Held-out rows, null labels and labels other than 0 and 1 are passed over; of labels that repeat an id, the lowest
    counts. Rows of ``docs`` that repeat an id count once each.
    """
    blocks = labelled_blocks(docs, labels, text)
    n, good = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    model = FactorisationMachine()
    if 0 < good < n:
        model.fit(lambda m: mean_loss(blocks, n, m), good / n)
    else:
        model.constant(good / max(1, n))
    drop_written(blocks)
    return model


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text") -> DataFrame:
    """``docs`` with score (double, 0 to 1); a column of this name is replaced.

    A null text scores like an empty one. Rows are independent: repeated rows score alike, an empty table gives an
    empty one. One pass without a shuffle; texts are read whole.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, v = shared.value
        local, make = FactorisationMachine(bias=bias, w=w, v=v), Featurizer()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                scores = [local.score(*make(t.as_py() or "")) for t in batch.column(text)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, text: str = "text") -> DataFrame:
    """Trains on the labels and returns ``docs`` with score and predicted (int, 1 where score >= ``cut``)."""
    model = train(docs, labels, text)
    return score(docs.drop("predicted"), model, text).withColumn("predicted", (F.col("score") >= cut).cast("int"))
