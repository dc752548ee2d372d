"""N-gram Jaccard join: signature trees with dual traversal inside blocks that no link leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_limits, if_small, mix64, own_names, shingle_hashes, shuffle_partitions, tidy, utf8, word_hashes, written
from quillstone.llm.components import connected_components

#: Documents of a leaf of the tree, and children of an inner node.
LEAF, FAN = 8, 4
#: Bits of a token bitmap a shingle of the block's largest set, at most MAX_BITS.
BITS_A_SHINGLE, MAX_BITS = 4, 1 << 16
#: Documents and shingles of a block that one task joins; larger blocks are dealt out in pairs of chunks, up to DIRECT chunks.
CHUNK_DOCS, CHUNK_SHINGLES, DIRECT = 2048, 1 << 23, 8
#: Signature rows that a task combines before it sends them on, and documents of one signature that it ties together.
COMBINE, HOT = 1 << 21, 1024
#: Shingles that signatures leave out: the most frequent ones, of those that at least OFTEN of a task's sets hold. Which they
#: are, and that they are no more than FREQUENT, changes the work but no result.
FREQUENT, OFTEN = 1 << 17, 8
#: Documents of a signature that are compared in pairs, and from which on all are taken as able to link.
SMALL, ALL_GLUED = 16, 1 << 15
#: Rows that a task takes in before it looks for whole signatures, and rows of a partition, about: more texts, more partitions.
MEET, PARTITION_ROWS = 1 << 18, 1 << 19
#: The bitmap that leaves out other documents has 1 << SLOT_BITS bits.
SLOT_BITS = 27
#: A signature's low bits: its size class, and whether its part is empty.
CLASS, EMPTY = 63, 64
#: Times that documents which share too few signatures are taken out, and the share of rows below which it is not worth while.
ROUNDS, LEAST_OUT = 4, 0.05
_SALT = np.uint64(0x5851F42D4C957F2D)
_LAST = np.iinfo(np.int64).max


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; empty without words."""
    raw = np.frombuffer(utf8(text), dtype=np.uint8)
    return np.unique(shingle_hashes(word_hashes(raw, lower=True), words))


def min_overlap(a, b, percent: int):
    """The least intersection with which sets of sizes a and b link: 100 * i >= percent * (a + b - i), exactly."""
    return -((-percent * (a + b)) // (100 + percent))


def part_count(upper: int, percent: int) -> int:
    """Parts into which sets of up to ``upper`` shingles are dealt: so many more than the differences a link can have that
    about all sets fill more parts than that."""
    differences = 2 * upper * (100 - percent) // (100 + percent)
    return differences + 1 + differences // 20 + 6


def most_differences(n, c, percent: int):
    """The most elements in which a set of size n can differ from one that links with it and signs in class c too."""
    return np.minimum(2 * (1 << c) * (100 - percent) // (100 + percent), n * (100 - percent) // percent)


def signatures(s: np.ndarray, percent: int, n: int | None = None) -> np.ndarray:
    """Hashes such that any two sets that link share one (so that documents that share none need no comparison).

    ``s`` is the set, or what is left of it and its size ``n``: any shingles may be left out, if from all sets, as they
    cannot make what is left differ in more elements.

    Size classes double. Within a class all sets are dealt by hash into the same parts, more than the elements in which
    linked sets can differ, each of which spoils one part of either set: some part must be equal in both. A set signs each
    of its filled parts by its number and content. If a set has fewer filled parts than differences are possible plus one,
    it signs its empty parts too; of two linked sets either one has enough filled parts, one of which is equal in the
    other, or both sign empty parts as well. Sets near their class's upper end also sign in the next class. The low bits
    tell the class and empty parts, as a set shares as many signatures of a class with each that it links with as it has
    filled parts beyond the differences that are possible.
    """
    sign = lambda x, c, low: mix64(x + np.uint64(c + 1)) & np.uint64(~(CLASS | EMPTY) & (1 << 64) - 1) | np.uint64(c | low)
    n = len(s) if n is None else n
    out = []
    own = max(0, (n - 1).bit_length())  # sizes in (2**(own-1), 2**own]
    classes = [own]
    if 100 * n > percent * (1 << own):  # a linked set can be beyond the class
        classes.append(own + 1)
    for c in classes:
        parts = part_count(1 << c, percent)
        at = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.empty(0, np.int64)
        if len(s):  # s is sorted, so at is too: parts are runs
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums = np.add.reduceat(mix64(s ^ _SALT), first)
            out.append(sign(sums + at[first] * _SALT, c, 0))
        if len(first) <= most_differences(n, c, percent):
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[first])
            out.append(sign(empty * _SALT, c, EMPTY))
    return np.concatenate(out)


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the sets hold, and how many."""
    found, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
    often = counts >= max(OFTEN, len(sets) // 500)
    return found[often], counts[often]


def _digests(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The size of each row's shingle set, 128 bits of its content and its sketch; and rows without doc_id, with minus a count
    and a shingle, of shingles that many of the task's sets hold."""
    names = ["doc_id", "n", "d1", "d2", "id", "s0", "s1"]
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()

    def frequent() -> pa.RecordBatch:
        shingles, counts = _frequent(held)
        held.clear()
        none = pa.nulls(len(shingles), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(-counts, pa.int64()), pa.array(shingles.view(np.int64)), none, none, none, none], names)

    for batch in batches:
        n, d1, d2, sketches = [], [], [], []
        for value in batch.column("text"):
            s = shingle_set(value.as_py(), words)
            n.append(len(s))
            d1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
            d2.append(int(mix64(s ^ _SALT).sum(dtype=np.uint64).view(np.int64)))
            sketches.append(sketch(s).view(np.int64))
            if (d1[-1], d2[-1]) not in seen:  # a set counts once
                seen.add((d1[-1], d2[-1]))
                held.append(s)
        both = np.array(sketches, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), batch.column("id"), *map(pa.array, both)], names)
        if sum(map(len, held)) > COMBINE:
            yield frequent()
            seen.clear()
    yield frequent()


def sketch(s: np.ndarray) -> np.ndarray:
    """Two words: the set's elements counted by hash into 32 buckets, each count modulo 16."""
    counts = np.bincount((s >> np.uint64(20) & np.uint64(31)).astype(np.int64), minlength=32) & 15
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).view(np.uint64)


def _nibbles(words: np.ndarray) -> np.ndarray:
    """Sketches (rows, 2) as counts (rows, 32)."""
    raw = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 16)
    return np.concatenate([raw & 15, raw >> 4], axis=1).astype(np.int8)


def possible(ca, na, cb, nb, percent: int) -> np.ndarray:
    """Whether sets with these counts and sizes can link: counts differ by no more, in all, than linked sets' elements do,
    and going round at 16 makes differences smaller only."""
    off = np.abs(ca - cb)
    least = np.minimum(off, 16 - off).sum(axis=-1, dtype=np.int64)
    return (least * (100 + percent) <= (na + nb) * (100 - percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _components(counts: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For each of a signature's documents the first of those that ``possible`` joins it with, directly or not: each found one
    is compared with those not found yet, so a group of near copies costs about its size."""
    label, left = np.arange(len(n)), np.arange(len(n))
    while len(left) > 1:
        queue, left, top = [int(left[0])], left[1:], int(left[0])
        while queue and len(left):
            i = queue.pop()
            hit = possible(counts[i], n[i], counts[left], n[left], percent)
            found = left[hit]
            label[found] = top
            queue += found.tolist()
            left = left[~hit]
    return label


def _group_edges(key: int, doc: np.ndarray, home: np.ndarray, counts: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Edges that join up what ``possible`` joins among a signature's documents, or all of them where one stands for others
    (minus its size); but not what their home, a signature of each document, joins already where they have it in common."""
    size, before = np.abs(n), np.arange(len(n))
    for h in np.unique(home[home != key]).tolist():
        at = np.flatnonzero(home == h)
        if len(at) > 1:
            before[at] = at[_components(counts[at], size[at], percent)]
    first = np.unique(before)
    if len(first) == 1:
        return np.empty((0, 2), np.int64)
    together = np.zeros(len(n), np.int64) if (n < 0).any() else _components(counts, size, percent)
    order = first[np.argsort(together[first], kind="stable")]
    lead = np.flatnonzero(np.concatenate([[True], np.diff(together[order]) != 0]))
    to = np.repeat(order[lead], np.diff(np.append(lead, len(order))))
    return np.stack([doc[to], doc[order]], axis=1)[to != order]


def _sorted_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


_SIGNED = ["key", "doc", "home", "s0", "s1", "n", "edge"]
_SIGNED_SCHEMA = "key long, doc long, home long, s0 long, s1 long, n int, edge boolean"


def _signed_batch(rows: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """Rows (key, doc, home, s0, s1, n), then edges (key: one end, doc: the other)."""
    columns = [np.concatenate([rows[:, i], pairs[:, i] if i < 2 else np.zeros(len(pairs), np.int64)]) for i in range(6)]
    flags = np.concatenate([np.zeros(len(rows), bool), np.ones(len(pairs), bool)])
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5].astype(np.int32)), pa.array(flags)], _SIGNED)


def _sign(batches: Iterator[pa.RecordBatch], words: int, percent: int, frequent: bytes) -> Iterator[pa.RecordBatch]:
    """(signature, document, home, sketch, size) rows; signatures leave out the ``frequent`` shingles. A document's home is its
    least signature of those that the task has more than once, as its near copies are likely to have it too, else its least.
    Copies of one set within a task are signed once, by the first; a signature with over HOT documents in the task goes on
    with its first one, with minus its size, and the others are tied to it by edges."""
    parts: list[np.ndarray] = []
    edges: list[tuple[int, int]] = []
    copies: dict[bytes, int] = {}
    common = np.frombuffer(frequent, dtype=np.uint64)

    def combined() -> pa.RecordBatch:
        rows = np.concatenate(parts) if parts else np.empty((0, 6), np.int64)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        starts, sizes = _sorted_groups(rows[order, 0])
        if len(rows):
            often = np.empty(len(rows), bool)
            often[order] = np.repeat(sizes > 1, sizes)
            each = np.array([len(p) for p in parts])
            least = lambda k: np.minimum.reduceat(k, np.cumsum(each) - each)
            shared = least(np.where(often, rows[:, 0], _LAST))
            rows[:, 2] = np.repeat(np.where(shared == _LAST, least(rows[:, 0]), shared), each)
        keep = np.ones(len(rows), bool)  # in the order of documents: a partition's rows of one document compress well
        tied = [np.array(edges, dtype=np.int64).reshape(-1, 2)]
        for at, size in zip(starts[sizes > HOT].tolist(), sizes[sizes > HOT].tolist(), strict=True):
            others = order[at + 1 : at + size]
            keep[others] = False
            tied.append(np.stack([np.full(size - 1, rows[order[at], 1]), rows[others, 1]], axis=1))
            rows[order[at], 5] *= -1  # it stands for documents that its sketch and size say nothing about
        out = _signed_batch(rows[keep], _joined_up(np.unique(np.concatenate(tied), axis=0)))
        parts.clear(), edges.clear()
        return out

    held = 0
    for batch in batches:
        for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            s = shingle_set(value.as_py(), words)
            if doc is None or not len(s):
                continue
            digest = mix64(s).sum(dtype=np.uint64).tobytes() + mix64(s ^ _SALT).sum(dtype=np.uint64).tobytes()
            first = copies.get(digest)
            if first is not None:
                if first != doc:  # a repeated row is signed once
                    edges.append((first, doc))
                    held += 1
            else:
                copies[digest] = doc
                rare = s
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rare = s[common[at] != s]
                sig = signatures(rare, percent, len(s)).view(np.int64)
                rows = np.empty((len(sig), 6), dtype=np.int64)
                rows[:, 0], rows[:, 1], rows[:, 5] = sig, doc, len(s)
                rows[:, 3:5] = sketch(s).view(np.int64)
                parts.append(rows)
                held += len(sig)
            if held >= COMBINE:
                yield combined()
                copies.clear()
                held = 0
    yield combined()


#: Kinds of narrow rows: a signature and its document, one that stands for others too, the ends of an edge, and a document
#: with the signatures of a class that it shares with each document that it links with.
ROW, STANDS, EDGE, NEED = range(4)
_NARROW = "key long, doc long, kind int"


def _narrow_batch(key, doc, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(kind, pa.int32())], ["key", "doc", "kind"])


def _narrow(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """What ``_sign`` gives as narrow rows: homes, sketches and sizes would move with each signature, and among many partitions
    hardly compress, as few rows of a document meet in one. Rows of kind NEED hold (document, class << 32 | signatures)."""
    for batch in batches:
        key, doc, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "n"))
        edge = batch.column("edge").to_numpy(zero_copy_only=False)
        yield _narrow_batch(key, doc, np.where(edge, EDGE, np.where(n < 0, STANDS, ROW)))
        key, doc, n = key[~edge], doc[~edge], np.abs(n[~edge])
        if len(key):
            c = key & CLASS
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (c[1:] != c[:-1])]))
            filled = np.add.reduceat((key & EMPTY == 0).astype(np.int64), at)  # without those that another stands for
            need = np.maximum(0, filled - most_differences(n[at], c[at], percent))
            yield _narrow_batch(doc[at], c[at] << 32 | need, np.full(len(at), NEED))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, doc and falling kind: once each, those of keys that several documents have or one that stands for
    others; other kinds of rows as they come. One row is held between batches."""
    held, sent = np.empty((0, 3), np.int64), None
    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        if (other := rows[rows[:, 2] > STANDS]).size:
            yield _narrow_batch(*other.T)
        rows = np.concatenate([held, rows[rows[:, 2] <= STANDS]])
        before = np.concatenate([rows[:1] if sent is None else sent, rows[:-1]])[: len(rows)]
        same, again = rows[:, 0] == before[:, 0], (rows[:, :2] == before[:, :2]).all(axis=1)
        if sent is None:
            same[:1] = again[:1] = False
        rows, same = rows[~again], same[~again]
        if not len(rows):
            continue
        kept = same | (rows[:, 2] == STANDS)
        kept[:-1] |= same[1:]
        held, sent = (rows[:0], rows[-1:]) if kept[-1] else (rows[-1:], rows[-2:-1] if len(rows) > 1 else sent)
        yield _narrow_batch(*rows[kept].T)


def _joined_up(edges: np.ndarray) -> np.ndarray:
    """Edges from the smallest to every other document of each component of ``edges``: as few as join the same."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = parent[x]
        return x

    for a, b in edges.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(find(x), x) for x in list(parent)]
    return np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)


def _met(rows: np.ndarray, percent: int) -> list[np.ndarray]:
    """Edges of whole signatures, from their rows sorted by them."""
    same = rows[1:, 0] == rows[:-1, 0]
    shared = np.zeros(len(rows), bool)
    shared[1:] |= same
    shared[:-1] |= same
    rows = rows[shared]
    rows = rows[np.lexsort((rows[:, 5], rows[:, 1], rows[:, 0]))]
    key, doc, home, n = (rows[:, i] for i in (0, 1, 2, 5))
    starts, sizes = _sorted_groups(key)
    if not len(starts):
        return []
    alone = (sizes > SMALL) | (np.minimum.reduceat(n, starts) < 0)
    out, in_small = [], np.repeat(~alone, sizes)
    for k in range(1, SMALL):  # all pairs of small groups, one distance at a time
        x = np.flatnonzero((key[k:] == key[:-k]) & in_small[k:])
        if not len(x):
            break
        x = x[(home[x] != home[x + k]) | (home[x] == key[x])]
        y = x + k
        hit = possible(_nibbles(rows[x, 3:5]), n[x], _nibbles(rows[y, 3:5]), n[y], percent)
        out.append(np.stack([doc[x[hit]], doc[y[hit]]], axis=1))
    for at, size in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True):
        g = slice(at, at + size)
        out.append(_group_edges(int(key[at]), doc[g], home[g], _nibbles(rows[g, 3:5]), n[g], percent))
    return out


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition that has all rows of its signatures, sorted by them, which join up what the edges between
    documents that share a signature and can link, and those that came along, join.

    Documents of one home meet at that signature, and are not joined again at others. All documents of a
    signature are joined where one of its rows stands for others (minus its size): any of those may be able to link with any
    of the rest; so are those of a signature with over ALL_GLUED rows. No more rows than that are held besides MEET new
    ones, and edges are sent on when there are COMBINE."""
    ties: list[np.ndarray] = []
    held, new = np.empty((0, 6), np.int64), []

    def sent() -> pa.RecordBatch:
        found = _joined_up(np.unique(np.sort(np.concatenate([np.empty((0, 2), np.int64), *ties]), axis=1), axis=0))
        ties.clear()
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["a", "b"])

    def whole(last: bool) -> np.ndarray:
        rows = np.concatenate([held, *new])
        new.clear()
        begins = len(rows) if last or not len(rows) else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        ties.extend(_met(rows[:begins], percent))
        rest = rows[begins:].copy()
        if len(rest) > ALL_GLUED:
            ties.append(np.stack([np.full(len(rest) - 1, rest[0, 1]), rest[1:, 1]], axis=1))
            rest = rest[:1]
            rest[0, 5] = -abs(rest[0, 5])
        return rest

    for batch in batches:
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
        edge = batch.column("edge").to_numpy(zero_copy_only=False)
        new.append(columns[~edge])
        if edge.any():
            ties.append(columns[edge, :2])
        if sum(map(len, new)) >= MEET:
            held = whole(False)
            if sum(map(len, ties)) >= COMBINE:
                yield sent()
    held = whole(True)
    yield sent()


def _listed(batches: Iterator[pa.RecordBatch], bitmap: bytes) -> Iterator[pa.RecordBatch]:
    """The rows whose ``slot`` is set in the bitmap: all members, and others by chance only."""
    bits = np.frombuffer(bitmap, dtype=np.uint8)
    for batch in batches:
        slot = batch.column("slot").to_numpy()
        yield batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))


def _only_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``df`` (doc_id, text) that may be members (doc), by a bitmap of fixed size (1 << SLOT_BITS bits) made by
    Spark: what is left out need not be shuffled to the join that decides."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SLOT_BITS))
    at = members.select((slot("doc") + 1).alias("slot"))  # the bitmap functions count from 1
    made = at.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    bitmap = bytearray(1 << (SLOT_BITS - 3))
    for r in made.toLocalIterator():
        size = len(r["m"])
        bitmap[(r["b"] - 1) * size : r["b"] * size] = r["m"]
    shared = df.sparkSession.sparkContext.broadcast(bytes(bitmap))
    rows = df.select("doc_id", "text", slot("doc_id").alias("slot")).where("slot IS NOT NULL")
    return rows.mapInArrow(lambda b: _listed(b, shared.value), "doc_id long, text string, slot long").drop("slot")


class SignatureTree:
    """Sets in order of size, leaves of LEAF and nodes of FAN children, each with the OR of its token bitmaps, its range of
    sizes, and the most shingles of one set that share a bit with another."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:4].tolist()))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for row, s in enumerate(self.sets):
            at = np.unique(mix64(s) & np.uint64(bits - 1))
            np.bitwise_or.at(self.maps[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.spare = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        starts = np.arange(0, len(sets), LEAF)
        self.levels = [self._level(starts, self.maps, self.sizes, self.sizes, self.spare, len(sets))]
        while len(self.levels[-1]["lo"]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below["lo"]), FAN)
            self.levels.append(self._level(at, below["maps"], below["lo"], below["hi"], below["spare"], len(below["lo"])))

    @staticmethod
    def _level(starts, maps, lo, hi, spare, count) -> dict:
        return {
            "maps": np.bitwise_or.reduceat(maps, starts, axis=0), "lo": np.minimum.reduceat(lo, starts),
            "hi": np.maximum.reduceat(hi, starts), "spare": np.maximum.reduceat(spare, starts), "count": count,
        }

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = LEAF * FAN**level
        return node * width, min(len(self.sets), (node + 1) * width)


def tree_links(sets: list[np.ndarray], side: list[int], percent: int, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join up all sets which links join: a spanning forest, found by traversing the tree against itself.

    A pair of nodes is left out when its size ranges cannot link, when the shared bits of its bitmaps plus the shingles that
    may share one are fewer than the least overlap of its smallest sets, or when all of both is joined already. What leaves
    remain is compared bitmap by bitmap, then exactly. With ``side`` 0 and 1, pairs of one side are left out. Sets of one of
    ``parts`` are joined from the start.
    """
    if len(sets) < 2:
        return []
    most = max(map(len, sets))
    bits = min(MAX_BITS, 1 << max(6, (BITS_A_SHINGLE * most - 1).bit_length()))
    tree = SignatureTree(sets, bits)
    label, sides, links = np.arange(len(sets)), np.array([side[i] for i in tree.order]), []
    if parts is not None:
        label = np.unique(np.array(parts)[tree.order], return_inverse=True)[1]
    two_sided = len(set(side)) > 1

    def joined(a: tuple[int, int], b: tuple[int, int]) -> bool:
        x = label[a[0]]
        return bool((label[a[0] : a[1]] == x).all() and (label[b[0] : b[1]] == x).all())

    def compare(a: tuple[int, int], b: tuple[int, int]) -> None:
        rows, cols = np.arange(*a), np.arange(*b)
        na, nb = tree.sizes[rows][:, None], tree.sizes[cols][None]
        shared = np.bitwise_count(tree.maps[rows][:, None] & tree.maps[cols][None]).sum(axis=2, dtype=np.int64)
        shared = shared + np.minimum(tree.spare[rows][:, None], tree.spare[cols][None])
        able = (shared >= min_overlap(na, nb, percent)) & (rows[:, None] < cols[None])
        if two_sided:
            able &= sides[rows][:, None] != sides[cols][None]
        for i, j in np.argwhere(able):
            i, j = int(rows[i]), int(cols[j])
            if label[i] == label[j]:
                continue
            x, y = tree.sets[i], tree.sets[j]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            if int((y[at] == x).sum()) >= min_overlap(len(x), len(y), percent):
                links.append((tree.order[i], tree.order[j]))
                label[label == label[j]] = label[i]

    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, p, q = stack.pop()
        t = tree.levels[level]
        if p != q:
            if 100 * t["hi"][p] < percent * t["lo"][q] or 100 * t["hi"][q] < percent * t["lo"][p]:
                continue
            reach = int(np.bitwise_count(t["maps"][p] & t["maps"][q]).sum(dtype=np.int64)) + min(t["spare"][p], t["spare"][q])
            if reach < min_overlap(int(t["lo"][p]), int(t["lo"][q]), percent):
                continue
        if joined(a := tree.span(level, p), b := tree.span(level, q)):
            continue
        if level == 0:
            compare(a, b)
            continue
        n = t["count"]
        left, right = range(p * FAN, min(n, p * FAN + FAN)), range(q * FAN, min(n, q * FAN + FAN))
        below = [(level - 1, x, y) for x in left for y in right if p != q or x <= y]
        below.sort(key=lambda c: c[1] == c[2])  # a node against itself is taken first: near sets join early
        stack.extend(below)
    return links


def _join_blocks(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the blocks of a partition that is sorted by (block, first, second); one block is held at a time."""
    held: tuple | None = None
    docs, sets, side, parts = [], [], [], []

    def done() -> pa.RecordBatch:
        links = tree_links(sets, side, percent, parts)
        pairs = [[docs[i] for i, _ in links], [docs[j] for _, j in links]]
        docs.clear(), sets.clear(), side.clear(), parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "first", "second")), strict=True))
        chunks, ids, texts = batch.column("chunk").to_pylist(), batch.column("doc").to_pylist(), batch.column("text")
        for key, chunk, doc, part, value in zip(keys, chunks, ids, batch.column("part").to_pylist(), texts, strict=True):
            if held is not None and key != held:
                yield done()
            held = key
            docs.append(doc)
            parts.append(part)
            sets.append(shingle_set(value.as_py(), words))
            side.append(int(chunk != key[1]))
    if docs:
        yield done()


def _links(sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of sets (doc, block, part, chunk, low, high, text): each chunk of a block meets its chunks from low to high,
    itself included, once. What is one part is joined already."""
    other = F.explode(F.sequence("low", "high")).alias("other")
    dealt = sets.select("doc", "block", "part", "chunk", "text", other)
    dealt = dealt.select("doc", "block", "part", "chunk", "text", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"))
    keys = ["block", "first", "second"]
    dealt = dealt.repartition(shuffle_partitions(sets.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda b: tidy(_join_blocks(b, words, percent)), "a long, b long")


def _chunked(sets: DataFrame, by: list[str]) -> DataFrame:
    """``sets`` with the number of chunks that their group of ``by`` takes, and the chunk of each."""
    sizes = sets.groupBy(*by).agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    count = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    out = sets.join(if_small(written(sizes.select(*by, count.alias("chunks")), "chunks")), by)
    return out.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))


def _large_links(sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of the sets (doc, block, n, text) of large blocks, whose chunks cannot all meet: a group of near copies would move
    with its square.

    Chunks are joined alone first, and what is joined is a part of its block. Then one document of each part meets those of
    all others, by which groups of near copies become one part as a rule. What is left are documents outside their block's
    largest part: they meet all others of the block, so all pairs are compared or joined, and a text moves as often as
    there are chunks of those.
    """
    sets = written(_chunked(sets, ["block"]).drop("chunks"), "large-blocks")
    alone = sets.withColumns({"part": F.col("doc"), "low": F.col("chunk"), "high": F.col("chunk")})
    found = written(_links(alone, words, percent), "links")

    def parted(found: DataFrame) -> DataFrame:
        top = if_small(written(connected_components(found), "parts"))  # texts stay where they are if there are few
        return sets.drop("chunk").join(top, F.col("doc") == F.col("node"), "left").withColumn("part", F.coalesce("label", "doc")).drop("node", "label")

    first = _chunked(parted(found).where("part = doc"), ["block"])
    first = first.withColumns({"low": F.lit(0), "high": F.col("chunks") - 1})
    found = written(found.unionByName(_links(first, words, percent)), "links")
    every = written(parted(found), "parted")
    size = every.groupBy("block", "part").agg(F.count("*").alias("docs"))
    largest = size.groupBy("block").agg(F.max(F.struct("docs", "part")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    largest = if_small(written(largest.select("block", F.col("m.part").alias("largest")), "largest"))
    left = every.join(largest, "block").withColumn("outside", F.col("part") != F.col("largest"))
    left = _chunked(left, ["block", "outside"])
    of = lambda side: F.max(F.when(F.col("outside") == side, F.col("chunks")))
    counts = if_small(written(left.groupBy("block").agg(of(True).alias("others"), (of(True) + of(False)).alias("all")), "counts"))
    left = left.join(counts, "block").withColumns({"low": F.lit(0), "high": F.when(F.col("outside"), F.col("all")).otherwise(F.col("others")) - 1})
    left = left.withColumn("chunk", F.when(F.col("outside"), F.col("chunk")).otherwise(F.col("chunk") + F.col("others")))
    return found.unionByName(_links(left, words, percent))


def _only_shared(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "doc", F.desc("kind")).mapInArrow(lambda b: tidy(_shared(b)), _NARROW)


def _near(signed: DataFrame, rep_of: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join up what the narrow rows ``signed`` join; ``rep_of`` (doc, rep, n, s0, s1) knows all documents.

    Copies give way to their representative. Then, a few times, documents go that share fewer signatures of a class than they
    would with any one that they link with, or so many only with those that went: chance alone, which grows with the corpus,
    would join large sets to blocks that nothing else rules out. Rows that stand for others stay. Homes, sketches and sizes
    are joined to what is left.
    """
    parts, to = shuffle_partitions(signed.sparkSession), rep_of.select("doc", "rep")
    rows = signed.where(F.col("kind") <= STANDS).join(to, "doc").select("key", F.col("rep").alias("doc"), "kind")
    need = signed.where(F.col("kind") == NEED).select(F.col("key").alias("doc"), F.shiftright("doc", 32).alias("c"), F.col("doc").bitwiseAND(0xFFFFFFFF).alias("need"))
    need = need.join(to, "doc").groupBy(F.col("rep").alias("doc"), "c").agg(F.min("need").alias("need"))
    need, c = written(need.where("need > 0"), "need"), F.col("key").bitwiseAND(CLASS)
    rows = written(_only_shared(rows, parts), "shared")
    for _ in range(ROUNDS):
        has = rows.groupBy("doc", c.alias("c")).agg(F.sum((F.col("key").bitwiseAND(EMPTY) == 0).cast("long")).alias("has"))
        few = has.join(need, ["doc", "c"]).where("has < need").select("doc", "c")
        left = rows.withColumn("c", c).join(few.withColumn("few", F.lit(True)), ["doc", "c"], "left").where((F.col("kind") == STANDS) | F.col("few").isNull())
        size, rows = rows.count(), written(_only_shared(left.select("key", "doc", "kind"), parts), "shared")
        if size - rows.count() <= size * LEAST_OUT:
            break
    homes = rows.groupBy("doc").agg(F.min("key").alias("home")).join(rep_of.where("doc = rep").drop("rep"), "doc")
    n = F.when(F.col("kind") == STANDS, -F.col("n")).otherwise(F.col("n")).cast("int")
    rows = rows.join(homes, "doc").select("key", "doc", "home", "s0", "s1", n.alias("n"), F.lit(False).alias("edge"))
    met = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: tidy(_meet(b, percent)), "a long, b long")
    return met.unionByName(signed.where(F.col("kind") == EDGE).select(F.col("key").alias("a"), F.col("doc").alias("b")))


def near_duplicates(df: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of a table with doc_id and text.

    Words (lower-cased in A-Z) make sets of shingles; two rows link when 100 * intersection >= percent * union; component_id
    is the smallest doc_id that links reach, the row's own included. All links count, none is estimated:

    1. Rows are known by a hash of doc_id and text, so rows that repeat a doc_id with other texts link each by its own. Equal
       sets become one representative.
    2. Any two linked sets share a signature of what they hold besides shingles that are frequent everywhere, such as those of
       licence texts (see ``signatures``). Documents that share one and that sizes and a small
       sketch do not rule out are joined by an edge; the edges' components are blocks that no link leaves. Copies and a
       signature's hot groups are combined in each task before the shuffle.
    3. In each block a signature tree, traversed against itself, finds the links; blocks beyond CHUNK_DOCS documents are
       dealt out in pairs of chunks, those beyond DIRECT chunks by what is joined so far (see ``_large_links``).
    4. Links and representatives give components. Copies are never expanded into pairs.

    Edge cases: null and empty texts and texts without words have an empty set and link with nothing; fewer words than a
    shingle form one; a null doc_id is no end of a link but gets the component of equal sets, else null; repeated rows are
    equal sets; rows of one doc_id with other texts link only if their texts do; an empty table gives an empty result; other columns are ignored. doc_id is read as a long.
    """
    found = _linked(df, words, percent)
    smallest = found.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(smallest, "component", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _row_key() -> Column:
    """What tells rows apart: a hash of doc_id and text; null without doc_id."""
    at = F.col("doc_id").cast("long")
    return F.when(at.isNotNull(), F.xxhash64(at, F.col("text")))


def _linked(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, id, n, component) for each row: its key and doc_id, the size of its set, and the smallest key that links reach."""
    spark = df.sparkSession
    arrow_limits(spark)
    df = df.select(_row_key().alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"))
    found = written(df.mapInArrow(lambda b: tidy(_digests(b, words)), "doc_id long, n long, d1 long, d2 long, id long, s0 long, s1 long"), "digests")
    sizes = found.where("n >= 0")
    top = found.where("n < 0").groupBy("d1").agg(F.sum("n").alias("n")).orderBy("n", "d1").limit(FREQUENT).select("d1").toArrow()
    frequent = np.sort(top["d1"].to_numpy().view(np.uint64)).tobytes()
    first = sizes.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    of_doc = written(sizes.join(first, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep", "id", "s0", "s1"), "representatives")
    rep_of = of_doc.where("rep IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "rep", "n", "s0", "s1").dropDuplicates(["doc"])

    signed = df.mapInArrow(lambda b: tidy(_narrow(_sign(b, words, percent, frequent), percent)), _NARROW)
    shingles = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a set of the mean size of its class signs twice in so many parts at most
    partitions = max(shuffle_partitions(spark), part_count(shingles, percent) * 3 // 2 // PARTITION_ROWS)
    near = written(_near(written(_only_shared(signed, partitions), "signed"), rep_of, percent).distinct(), "near")  # an edge can come from several partitions
    near = near.join(rep_of.select(F.col("doc").alias("a"), F.col("rep").alias("ra")), "a").join(rep_of.select(F.col("doc").alias("b"), F.col("rep").alias("rb")), "b")
    near = near.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    blocks = connected_components(near)
    reps = rep_of.where("doc = rep").select("doc", "n")
    totals = blocks.join(reps, F.col("node") == F.col("doc")).groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    members = blocks.join(totals.select("label", chunks.alias("chunks")), "label").select(F.col("node").alias("doc"), F.col("label").alias("block"), "chunks")
    members = written(members.withColumn("large", F.col("chunks") > DIRECT), "members")
    sets = _only_members(df, members).join(members, F.col("doc_id") == F.col("doc")).select("doc", "block", "chunks", "large", "text")
    pairs = {"part": F.col("doc"), "chunk": F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"), "low": F.lit(0), "high": F.col("chunks") - 1}
    links = _links(sets.where("NOT large").withColumns(pairs), words, percent)
    if not members.where("large").isEmpty():
        big = sets.where("large").join(reps.withColumnRenamed("doc", "rep"), F.col("doc") == F.col("rep")).select("doc", "block", "n", "text")
        links = links.unionByName(_large_links(big, words, percent))
    joined = connected_components(links)
    out = of_doc.join(joined, F.col("rep") == F.col("node"), "left")
    component = F.coalesce(F.col("label"), F.col("rep"), F.col("doc_id"))
    return written(out.select(F.col("doc_id").alias("key"), "id", "n", component.alias("component")), "components")


@own_names
def keep_first(df: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of a table with doc_id and text without near duplicates: of each component one row of the smallest doc_id.

    Rows whose shingle set is empty, and all rows without doc_id, stay. Rows that repeat a doc_id with other texts are rows of
    their own: each stays that is its component's first; of a component's rows of the smallest doc_id the one with the
    smallest hash stays, and of rows that repeat doc_id and text one.
    """
    found = _linked(df.select("doc_id", "text"), words, percent).where("key IS NOT NULL")
    keep = found.groupBy("component").agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias("__key"))
    named = df.where("doc_id IS NOT NULL").withColumn("__key", _row_key()).dropDuplicates(["__key"]).join(keep, "__key", "left_semi")
    return named.drop("__key").unionByName(df.where("doc_id IS NULL"))
