"""Near-duplicates: SuperMinHash signatures, banding, verification on whole sets, union-find grouping.

SuperMinHash gives each element of a set a random permutation of the places of the signature; in round j an element
offers j plus a random fraction to the j-th place of its permutation, and a place keeps the least offer. Offers of
later rounds are larger, so work stops as soon as every place is filled: after a few rounds for sets larger than the
signature. The places are without replacement, so estimates vary less than those of independent hashes. The rounds run
over many sets at once, laid end to end; a set too large for that is taken in pieces, and its places keep the least
offer of all of them.

Rows with equal sets count once. Signatures are cut into bands; sets that share a band are candidates. Candidates
are linked to one centre of their bucket first, and confirmed on their full sets; union-find groups the links.
The centre is the bucket's most typical member. Where a bucket then still holds more than one group, the members outside
the centre's group are compared with a few more centres, and only what is apart even then with all others, leaving out
pairs that sizes or odd sketches rule out, which are certain bounds. So no link that banding finds is lost, and a bucket
of copies costs about as many pairs as it has members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map, drop_written, fresh_key, fresh_key_long, written

#: With 6 rows a band and 56 bands, a pair of similarity 0.8 shares no band once in 25 million.
ROWS, BANDS = 6, 56
PARITY = 1024
#: Members of a bucket that are tried as centres before all pairs of different groups are.
HUBS = 8
#: Members of an open bucket that one task holds against the others of it.
PORTION = 1000
#: Elements whose rounds run together, bytes of a text whose words are split together.
LAID, PIECE = 4096, 1 << 20
SKETCHES = [f"__o{k}" for k in range(PARITY // 64)]
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _parts(raw: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut at white space."""
    at = 0
    while len(raw) - at > PIECE:
        cut = _SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


class Shingler:
    """Texts to sorted arrays of the 64-bit hashes of their distinct shingles."""

    def __init__(self, size: int, keep: int = 200_000):
        self.size, self.keep, self.known = size, keep, {}

    def _hashes(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        for w in set().union(*words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The set of each text; words of all of them are hashed and joined to shingles together."""
        # of bytes: only A-Z change, and only the white space of ASCII divides words
        raws = [(t or "").encode().lower() for t in texts]
        hashes, counts, lot, held = [], [0] * len(raws), [], 0
        for k, raw in enumerate(raws):
            for part in _parts(raw):
                words = part.split()
                counts[k] += len(words)
                lot.append(words)
                held += len(part)
                if held > PIECE:
                    hashes.append(self._hashes(lot))
                    lot, held = [], 0
        hashes.append(self._hashes(lot))
        h = np.concatenate(hashes)
        out = h.copy()
        for k in range(1, self.size):
            out[: len(h) - k] = _mixed(out[: len(h) - k] * _STEP + h[k:])
        made, end = [], 0
        for raw, n in zip(raws, counts):
            start, end = end, end + n
            if n == 0:
                made.append(np.zeros(0, np.uint64))
            elif n < self.size:
                made.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(raw.split()), n)], np.uint64))
            else:
                one = np.sort(out[start : end - self.size + 1])
                made.append(one[np.r_[True, one[1:] != one[:-1]]])
        return made

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]


class _Signatures:
    """Places of the signatures of a few sets: by which round each was filled, the least offer, and whose it was."""

    def __init__(self, n: int, m: int):
        self.m, self.filled = m, np.full(n * m, m, np.int16)
        self.offer, self.kept = np.full(n * m, np.iinfo(np.uint64).max, np.uint64), np.zeros(n * m, np.uint64)

    def add(self, elements: np.ndarray, owner: np.ndarray) -> None:
        """All rounds of these elements; ``owner`` has each one's set, in ascending order."""
        m, n = self.m, len(elements)
        every = np.arange(n)
        places = np.empty((m, n), np.int16)
        places[:] = np.arange(m, dtype=np.int16)[:, None]
        base = owner * m
        for j in range(m):
            draw = _mixed(elements + np.uint64((j + 1) * int(_STEP) % 2**64))
            at = (j + (((draw >> np.uint64(40)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int64)) * n + every
            flat = places.reshape(-1)
            place = flat[at]
            flat[at] = places[j]
            # the j-th place of each permutation is now ``place``; only places that no earlier round has filled can take an offer
            cell = base + place
            open_ = np.flatnonzero(self.filled[cell] >= j)
            cell = cell[open_]
            offer = draw[open_]
            offer = (offer << np.uint64(24)) | (offer >> np.uint64(40))
            later = cell[self.filled[cell] > j]
            self.filled[later], self.offer[later] = j, np.iinfo(np.uint64).max
            np.minimum.at(self.offer, cell, offer)
            won = self.offer[cell] == offer  # offers of a round differ, as elements of a set do
            self.kept[cell[won]] = elements[open_[won]]
            if j % 4 == 3 or m - j < 4 or n > m:
                waits = (self.filled.reshape(-1, m).max(1) > j)[owner]
                left = int(waits.sum())
                if not left:
                    return
                if 2 * left < n:
                    elements, owner, base, places = elements[waits], owner[waits], base[waits], np.ascontiguousarray(places[:, waits])
                    n, every = left, np.arange(left)

    def table(self) -> np.ndarray:
        return self.kept.reshape(-1, self.m)


def super_minhashes(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The signature of each set (sets x ``m``): for each place the hash of the element with the least offer.

    Keeping the element's own hash instead of the offer makes equal places agree exactly. An empty set has zeros.
    """
    out = np.zeros((len(sets), m), np.uint64)
    order = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: len(sets[k]))  # sets of like size end alike
    lo = 0
    while lo < len(order):
        hi, total = lo + 1, len(sets[order[lo]])
        while hi < len(order) and total + len(sets[order[hi]]) <= LAID:
            total += len(sets[order[hi]])
            hi += 1
        chosen = order[lo:hi]
        made = _Signatures(len(chosen), m)
        if len(chosen) == 1:
            for at in range(0, total, LAID):
                piece = sets[chosen[0]][at : at + LAID]
                made.add(piece, np.zeros(len(piece), np.int64))
        else:
            made.add(np.concatenate([sets[k] for k in chosen]), np.repeat(np.arange(len(chosen)), [len(sets[k]) for k in chosen]))
        out[chosen] = made.table()
        lo = hi
    return out


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The signature of one set."""
    return super_minhashes([elements], m)[0]


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set an odd sketch: every element flips one of PARITY bits; as PARITY / 64 words."""
    out = np.zeros((len(sets), PARITY // 64), np.uint64)
    turns = np.arange(64, dtype=np.uint64)
    for k, items in enumerate(sets):
        odd = np.bincount((_mixed(items * _STEP) >> np.uint64(54)).astype(np.int64), minlength=PARITY) & 1
        out[k] = (odd.astype(np.uint64).reshape(-1, 64) << turns).sum(1, dtype=np.uint64)
    return out


def signatures(docs: DataFrame, size: int, rows: int = ROWS, bands: int = BANDS, text: str = "text") -> DataFrame:
    """``docs`` with __size (of the set), __set (a key equal for equal sets), __bands (array of long) and an odd sketch.

    The sketch, __o0 to __o15, has 1024 bits, each flipped by the elements that hash to it; so the bits in which two
    sketches differ are never more than the elements in which the sets differ.
    """
    m = rows * bands
    turns = (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _STEP
    salt = np.arange(bands, dtype=np.uint64) * _STEP
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(size), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle.sets(batch.column(text).to_pylist())
                keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                new = {k: s for k, s in zip(keys, sets) if k is not None and k not in known}
                if new:
                    if len(known) > 5_000:
                        known = {k: v for k, v in known.items() if k in set(keys)}
                    s = super_minhashes(list(new.values()), m)
                    banded = _mixed((_mixed(s.reshape(len(new), bands, rows) * turns)).sum(2, dtype=np.uint64) + salt).view(np.int64)
                    known.update(zip(new, zip(banded, _parities(list(new.values())).view(np.int64).tolist())))
                found = [known[k] if k is not None else (None, (None,) * len(SKETCHES)) for k in keys]
                columns = [*batch.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), pa.array([f[0] for f in found], pa.list_(pa.int64()))]
                columns += [pa.array([f[1][k] for f in found], pa.int64()) for k in range(len(SKETCHES))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "__size", "__set", "__bands", *SKETCHES])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return arrow_map(docs, run, fields + "__size bigint, __set string, __bands array<bigint>, " + ", ".join(f"{c} bigint" for c in SKETCHES))


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCHES), F.lit(0))


def _close(a: str, b: str, percent: int) -> Column:
    """Pairs that can reach the similarity: by their sizes and by their odd sketches, both certain bounds."""
    x, y = F.col(f"{a}.__size"), F.col(f"{b}.__size")
    sized = 100 * F.least(x, y) >= percent * F.greatest(x, y)
    return sized & ((100 + percent) * _differ(a, b) <= (100 - percent) * (x + y))


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their root, of buckets that hold more than one group; nodes without a link are their own root."""
    grouped = members.join(roots.select(fresh_key_long("id").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    spread = grouped.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    return grouped.join(spread.select(fresh_key_long("bucket").alias("bucket")), "bucket", "left_semi")


def _apart(members: DataFrame) -> DataFrame:
    """The members with ``main``, the root of their bucket's centre, and whether theirs is another."""
    main = members.filter("id = centre").select(fresh_key_long("bucket").alias("bucket"), F.col("root").alias("main"))
    return members.join(main, "bucket").withColumn("apart", F.col("root") != F.col("main"))


def _across(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members of one bucket and two groups that can reach the similarity.

    The left members of a bucket are dealt to portions of about PORTION by a hash, and the right ones go to each of
    these, so that no task holds all members of a large bucket against each other.
    """
    portions = F.ceil(F.col("n") / PORTION).cast("int")
    p = left.withColumn("portion", F.pmod(F.xxhash64("id"), portions).cast("int")).alias("p")
    q = right.withColumn("portion", F.explode(F.sequence(F.lit(0), portions - 1))).alias("q")
    meet = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.portion") == F.col("q.portion")) & (F.col("p.root") != F.col("q.root")) & _close("p", "q", percent)
    return p.join(q, meet).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the similarity; ``texts`` has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last = Shingler(size), (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keep = []
                firsts, column = batch.column("a").to_pylist(), batch.column("x")
                for a, k, two in zip(firsts, range(len(firsts)), shingle.sets(batch.column("y").to_pylist())):
                    if last[0] != a:
                        last = (a, shingle(column[k].as_py()))
                    one = last[1]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(100 * both >= percent * (len(one) + len(two) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    joined = pairs.select("a", "b").join(right, "b").select(fresh_key_long("a").alias("a"), "b", "y").join(left, "a")
    return arrow_map(joined.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def union_find(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b), root the least id that is reachable.

    Each task first unites its own edges and passes on one edge from each node to its root. Then every node takes the
    least root among its neighbours and itself, and the root of that root, until none changes; each round is written
    to the shared folder.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(map(find, part)), pa.int64())], ["id", "root"])

    forest = arrow_map(edges.select("a", "b"), local, "id bigint, root bigint")
    links = written(forest.filter("id != root").distinct())
    if links.isEmpty():
        drop_written(links)
        return edges.sparkSession.range(0).select(F.col("id"), F.col("id").alias("root"))
    both = links.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(links.select(F.col("root").alias("u"), F.col("id").alias("v")))
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["id"] == near["u"], "left").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("above"))
        new = step.join(jump, "root", "left").select("id", "old", F.least("root", "above").alias("root"))
        new = written(new)
        changed = new.filter("root != old").limit(1).count()
        drop_written(labels)
        labels = new
        if not changed:
            break
    drop_written(links)
    return labels.select("id", "root")


def _numbered(docs: DataFrame, size: int, rows: int, bands: int, text: str) -> DataFrame:
    """The signatures of ``docs`` as a table, with a number of each row, __row. Numbers are fixed by being written."""
    return written(signatures(docs, size, rows, bands, text).withColumn("__row", F.monotonically_increasing_id()))


def _classes(made: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(__set, first) of every set: first is the struct (none, doc_id, row) of the first row of the set's component.

    The first row is that of the least doc_id, null ones last, then of the least number. Nodes are rows, not ids, so rows
    that repeat an id with another text keep the links of their own text.
    """
    ranked = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col("__row").alias("row"))
    sets = made.filter("__set IS NOT NULL").select("__set", ranked.alias("r")).groupBy("__set").agg(F.min("r").alias("first"))
    sets = sets.select("first", F.col("first.row").alias("__row"))
    # rows with equal sets: the first one stands for them
    reps = written(made.join(sets, "__row").select(F.col("__row").alias("id"), "first", "__set", "__size", *SKETCHES, "__bands"))
    thin = reps.select("id", "__size", *SKETCHES)
    members = reps.select("id", F.explode("__bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(members.join(buckets.select(fresh_key_long("bucket").alias("bucket"), "n"), "bucket"))
    # the most typical member of a bucket, its centre, is the one whose buckets are fullest
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    centres = shared.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("m"))
    centres = written(centres.select("bucket", (-F.col("m.minus")).alias("centre")))
    texts = written(made.select(F.col("__row").alias("id"), F.col(text).alias("text")).join(degree.select("id"), "id", "left_semi"))
    stars = shared.join(centres, "bucket").filter("id != centre").select("id", "centre").distinct()
    q = thin.select("id", F.struct(*thin.columns).alias("q"))
    p = thin.select(F.col("id").alias("centre"), F.struct(*thin.columns).alias("p"))
    stars = stars.join(q, "id").join(p, "centre").filter(_close("p", "q", percent)).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    links = written(verify(stars, texts, size, percent))
    roots = written(union_find(links))
    # what is left: buckets that hold more than one group. Of large ones about HUBS members, the same in all buckets by a
    # hash of their id, are tried next, as one link is enough to join a group
    sized = shared.join(centres, "bucket").select("bucket", "id", "centre", "n")
    rest = _open_buckets(sized, roots).withColumn("hub", F.pmod(F.xxhash64("id"), F.greatest(F.floor(F.col("n") / HUBS), F.lit(1))) == 0)
    rest = written(_apart(rest).join(thin, "id"))
    done = [shared, centres, texts, links, rest]
    if not rest.isEmpty():
        second = written(verify(_across(rest.filter("apart"), rest.filter("hub AND id != centre"), percent), texts, size, percent))
        old, roots = roots, written(union_find(links.unionByName(second)))
        # then the members outside the centre's group against all others that are no hubs
        last = written(_apart(_open_buckets(rest.drop("root", "main", "apart"), roots)))
        later = written(verify(_across(last.filter("apart"), last.filter("NOT hub AND id != centre"), percent), texts, size, percent))
        done += [old, second, last, later]
        if not later.isEmpty():
            done.append(roots)
            roots = written(union_find(links.unionByName(second).unionByName(later)))
    for table in done:
        drop_written(table)
    # every set takes the first row of its component; sets without a link are their own
    linked = roots.join(reps.select("id", "first"), "id")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    headed = linked.select("id", "root").join(heads.select(fresh_key_long("root").alias("root"), "head"), "root").select("id", "head")
    return reps.select("id", "__set", "first").join(headed, "id", "left").select("__set", F.coalesce("head", "first").alias("first"))


def group(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; the set holds the distinct shingles of
    ``size`` words, or the whole sequence where there are fewer. Rows link where
    100 * intersection >= ``percent`` * union. component_id is the least doc_id reachable, the own one included, and
    kept says whether it is the own one. Rows without words, null texts too, link with nothing, so each is its own
    component. Rows are linked, not ids: rows that repeat an id and text are kept alike, and rows that repeat an id with
    another text go by their own text. A null doc_id gives a null component
    unless it links with others. An empty table gives an empty one; other columns are left out.
    """
    made = _numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), size, rows, bands, "text")
    named = _classes(made, size, percent, "doc_id", "text").select(fresh_key("__set").alias("__set"), F.col("first.doc_id").alias("component_id"), F.lit(True).alias("__named"))
    out = made.select("doc_id", F.col("__size").alias("n_shingles"), "__set").join(named, "__set", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("__named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``group``: that of the least doc_id, null ones last.

    Of rows that tie in that, copies of each other included, one stays. Rows without words, null texts too, all stay, and
    so do rows with a null doc_id that link with nothing. All columns are kept; none may begin with two underscores.
    """
    made = _numbered(docs, size, rows, bands, text)
    heads = _classes(made, size, percent, doc_id, text).select(F.col("first.row").alias("__row")).distinct()
    alone = made.filter("__set IS NULL").select(*docs.columns)
    return made.filter("__set IS NOT NULL").join(heads.select(fresh_key_long("__row").alias("__row")), "__row", "left_semi").select(*docs.columns).unionByName(alone)
