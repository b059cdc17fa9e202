"""MinHash near-dedup with an LSH forest (operator 5).

A document's set holds its distinct word shingles; two documents are linked
when ``100 * intersection >= percent * union``, and the result is the connected
components of all links.

1. Every text becomes a MinHash signature of TREES x PREFIX values, a sketch of
   64 four-bit values, and a digest of its whole set.  Documents of equal sets
   are linked at once and only one representative goes on.
2. The forest: each tree sorts the representatives by its own order of the
   signature.  Entries with the same first PREFIX values form a region; inside
   it they lie in the order of the following values, so neighbours share the
   longest prefixes.  A region is searched at its base depth while it is small.
   A region above REGION entries (a hot group of near copies) is first linked
   cheaply, within its runs of equal further values and between their first
   entries, where more than REGION entries are read block by block against the
   leaders found so far; step 5 then compares what is not linked yet.
3. Inside a region the sketches discard pairs that cannot reach the threshold
   (the cut is five standard deviations below it), and a maximum spanning forest
   of the rest becomes candidates: linked groups need no further pairs.
4. Candidates are verified on the full sets, read again from the texts; there
   words and shingles are compared as they are, not by hashed names.
5. Where a candidate fails and its region held other pairs that it stood for, the
   region's members are compared again on their full sets: one matrix product
   over the shingles that two of them share gives every intersection.  Regions
   above REGION entries, and those at the ends of a partition (a region may go on
   in the next one), are compared in any case: first one member of each component
   with those of the others, so that the pieces of a group grow together; then the
   members outside the region's largest component with all (pairs inside it are
   linked already).  A region of more than REGION members or REGION_BYTES of sets is dealt out in
   pairs of chunks of about BLOCK members and CHUNK_BYTES at most.  Only a forest of the links found leaves a task, and those links are
   verified like candidates.  So no pair that meets in any region goes untested
   unless its ends are already linked.

With 24 trees of base depth 4 a pair at exactly 0.8 is missed by all trees with
probability (1 - 0.8**4)**24 < 1e-5.

Defined results: texts without words (null, empty, blank) have an empty set,
are linked with nothing and stay; a text shorter than a shingle is one shingle;
equal rows are copies of each other (the first stays); a null doc_id never
names a component unless all of it is null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, fresh_heaps, materialize, table, with_row_ids
from .graph import components
from .textnp import U64, Words, _join, _join_numbers, both_words_of, mix, numbered_words, sequence_names, slices, trim, words_of

TREES, PREFIX, SKETCH = 24, 4, 64
REGION, BLOCK, CELLS = 2048, 1024, 1 << 24
#: Bytes of sets in a chunk of a region and in a region that one task compares whole, at most on average; entries of sets that are numbered together.
CHUNK_BYTES, REGION_BYTES, ENTRIES = 1 << 24, 1 << 25, 1 << 20
#: Bytes of text that are verified together.
PAIR_BYTES = 1 << 21
_RNG = np.random.Generator(np.random.PCG64(5))
_A = _RNG.integers(1, 2**64, TREES * PREFIX, dtype=U64) | U64(1)
#: Equal four-bit values in a byte of two, by the exclusive or of the bytes.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)
_SIGNED = "_row long, doc_id long, n_shingles long, set_key binary, sketch binary, regions array<long>, deeps array<long>"
_EDGES = "a long, b long, region long, spare boolean"


def _padded(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and starts of the texts, those of fewer than ``width`` words (but not of none) filled up with the name 0,
    and each entry's place in ``w`` (-1: filled up)."""
    n_words = np.diff(w.doc_start)
    size = np.where(n_words > 0, np.maximum(n_words, width), 0)
    if (size == n_words).all():
        return w.name, w.doc_start, np.arange(len(w.name))
    start = np.concatenate([[0], np.cumsum(size)])
    of = np.full(start[-1], -1)
    of[np.arange(len(w.name)) + np.repeat(start[:-1] - w.doc_start[:-1], n_words)] = np.arange(len(w.name))
    return np.where(of >= 0, w.name[of] if len(w.name) else U64(0), U64(0)), start, of


def shingle_sets(w: Words, width: int, join=_join) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of each text, end to end, and where each text's begin."""
    return double_sets(w, None, width, join)[::2]


def double_sets(w: Words, other: Words | None, width: int, join=_join) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """``shingle_sets`` with the same shingles' names by a second family of word names between the two."""
    name, start, of = _padded(w, width)
    n = np.diff(start)
    at = np.flatnonzero(np.repeat(start[1:], n) - np.arange(start[-1]) >= width)
    docs, names = np.repeat(np.arange(len(n)), n)[at], sequence_names(name, width, join)[at]
    order = np.lexsort((names, docs))
    docs, names, at = docs[order], names[order], at[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
    second = None
    if other is not None:
        second = sequence_names(np.where(of >= 0, other.name[of] if len(other.name) else U64(0), U64(0)), width, join)[at[new]]
    return names[new], second, np.searchsorted(docs[new], np.arange(len(n) + 1))


def signatures(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (texts x hashes, 32 bits) of non-empty sets that lie end to end."""
    out = np.empty((len(starts) - 1, len(_A)), np.uint32)
    step = 1 << 15  # entries at a time, so that a slice stays in cache
    doc = 0
    while doc < len(starts) - 1:
        last = max(doc + 1, int(np.searchsorted(starts, starts[doc] + step, side="right")) - 1)
        part, at = names[starts[doc] : starts[last]], starts[doc:last] - starts[doc]
        for k, factor in enumerate(_A):
            x = part * factor
            x ^= x >> U64(29)
            out[doc:last, k] = np.minimum.reduceat((x * U64(0xBF58476D1CE4E5B9)) >> U64(32), at)
        doc = last
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each value, two to a byte."""
    low = (sig & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(2)):
                names, second, starts = double_sets(*both_words_of(s, lower=True), width)
                size = np.diff(starts)
                full = np.flatnonzero(size)
                sig = signatures(names, np.append(starts[:-1][full], len(names))) if len(full) else np.zeros((0, TREES * PREFIX), np.uint32)
                total = np.zeros((len(size), 2), U64)
                if len(full):
                    for c, family in enumerate((names, second)):
                        total[full, c] = np.add.reduceat(mix(family), starts[:-1][full])
                sketch = packed(sig[:, :SKETCH])
                wide = sig.reshape(-1, TREES, PREFIX).astype(U64)
                region = np.broadcast_to(np.arange(1, TREES + 1, dtype=U64), wide.shape[:2])
                for k in range(PREFIX):
                    region = mix(region * U64(0x9E3779B97F4A7C15) + wide[:, :, k])
                nxt = np.roll(wide, -1, axis=1)
                deep = (nxt[:, :, 0] << U64(32)) | nxt[:, :, 1]
                lists, offsets = np.zeros(len(size) + 1, np.int32), np.zeros(len(size), np.int32)
                offsets[full] = TREES
                np.cumsum(offsets, out=lists[1:])
                sketches: list[bytes | None] = [None] * len(size)
                for k, d in enumerate(full):
                    sketches[d] = sketch[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s.first, s.n_docs), b.column(1).slice(s.first, s.n_docs), pa.array(size.astype(np.int64)),
                        pa.array([x.tobytes() for x in total], pa.binary()), pa.array(sketches, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(region.ravel().view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(deep.ravel().view(np.int64))),
                    ],
                    ["_row", "doc_id", "n_shingles", "set_key", "sketch", "regions", "deeps"],
                )
            trim()

    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the four-bit values agree, for each pair of rows (broadcast)."""
    return _EQUAL[x ^ y].sum(-1, dtype=np.int16)


def least_agreement(percent: int) -> int:
    """Five standard deviations below the agreement of a pair at the threshold."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5)


class _Forest:
    """Union by list index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class _Search:
    """Turns the runs of equal keys of a sorted stream into candidate pairs.

    Output rows: candidates (a, b), and for regions in which a candidate stands for further pairs
    (spare) their members as (a, a).  Members that are not spare are compared again in any case.
    """

    def __init__(self, least: int) -> None:
        self.least = least
        self.out: list[tuple] = []

    def small(self, region: int, ids: np.ndarray, sk: np.ndarray) -> None:
        """A maximum spanning forest of all pairs of a run that fits into memory."""
        n, found = len(ids), []
        for at in range(0, n, BLOCK):
            for to in range(at, n, BLOCK):
                step = max(1, CELLS // (BLOCK * sk.shape[1]))
                for x in range(at, min(n, at + BLOCK), step):
                    agree = _agreement(sk[x : x + step, None][: at + BLOCK - x], sk[None, to : to + BLOCK])
                    i, j = np.nonzero(agree >= self.least)
                    e = agree[i, j]
                    i, j = i + x, j + to
                    ok = i < j
                    found.append((i[ok], j[ok], e[ok]))
        i, j, e = (np.concatenate(x) for x in zip(*found))
        forest, picked = _Forest(n), []
        for k in np.argsort(-e, kind="stable"):
            if forest.join(int(i[k]), int(j[k])):
                picked.append((int(ids[i[k]]), int(ids[j[k]])))
                if len(picked) == n - 1:
                    break
        spare = len(i) > len(picked)
        self.out += [(a, b, region, spare) for a, b in picked]
        if spare:
            self.out += [(int(a), int(a), region, True) for a in ids[np.unique(np.concatenate([i, j]))]]

    def large(self, region: int, ids: np.ndarray, sk: np.ndarray) -> None:
        """A run above REGION entries: each entry joins the leader it agrees with best, or becomes one."""
        leaders = np.zeros(0, np.int64)
        for at in range(0, len(ids), BLOCK):
            rows = np.arange(at, min(len(ids), at + BLOCK))
            best, hit = np.full(len(rows), -1, np.int16), np.zeros(len(rows), np.int64)
            for x in range(0, len(leaders), BLOCK):
                self._nearest(sk, rows, leaders[x : x + BLOCK], best, hit)
            while True:
                far = np.flatnonzero(best < self.least)
                if not len(far):
                    break
                leaders = np.append(leaders, rows[far[0]])
                best[far[0]], hit[far[0]] = SKETCH + 1, rows[far[0]]
                self._nearest(sk, rows, leaders[-1:], best, hit)
            self.out += [(int(ids[x]), int(ids[y]), region, True) for x, y in zip(rows, hit) if x != y]
        self.out += [(int(a), int(a), region, True) for a in ids]

    @staticmethod
    def _nearest(sk: np.ndarray, rows: np.ndarray, leaders: np.ndarray, best: np.ndarray, hit: np.ndarray) -> None:
        agree = _agreement(sk[rows, None], sk[None, leaders])
        k = agree.argmax(1)
        e = agree[np.arange(len(rows)), k]
        better = e > best
        best[better], hit[better] = e[better], leaders[k[better]]

    def region(self, region: int, deep: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> None:
        if len(ids) <= REGION:
            return self.small(region, ids, sk)
        cut = np.flatnonzero(np.append(True, deep[1:] != deep[:-1]))
        found, self.out = self.out, []
        for a, b in zip(cut, np.append(cut[1:], len(ids))):
            if b - a > 1:
                (self.small if b - a <= REGION else self.large)(region, ids[a:b], sk[a:b])
        if len(cut) > 1:
            (self.small if len(cut) <= REGION else self.large)(region, ids[cut], sk[cut])
        self.out = found + [(a, b, region, False) for a, b, _, _ in self.out if a != b]
        self.whole(region, ids)

    def whole(self, region: int, ids: np.ndarray) -> None:
        """The members of a region that is compared again in any case."""
        self.out += [(int(a), int(a), region, False) for a in ids]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of binaries of one width as a matrix of bytes."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    first = np.frombuffer(offs, np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(column) * width].reshape(-1, width)


def _runs(batches: Iterator[pa.RecordBatch], width: int):
    """Blocks of whole regions of a stream sorted by region: the columns, the last of them a matrix, and each region's bounds."""
    held: list[list[np.ndarray]] = []  # parts of a region that may go on

    def whole():
        cols = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return cols, np.zeros(1, np.int64), np.array([len(cols[0])])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns - 1)] + [_matrix(b.column(b.num_columns - 1), width)]
        if held and held[-1][0][-1] != cols[0][0]:
            yield whole()
        cut = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        if held and len(cut) > 1:  # the open region ends here
            held.append([c[: cut[1]] for c in cols])
            yield whole()
            cols, cut = [c[cut[1] :] for c in cols], cut[1:] - cut[1]
        if cut[-1] > 0:
            yield [c[: cut[-1]] for c in cols], cut[:-1], cut[1:]
        held.append([c[cut[-1] :] for c in cols])
    if held:
        yield whole()


def _edges(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "region", "spare"])


def _candidates(percent: int):
    """Candidate pairs from rows (region, deep, id, sketch) sorted by region and deep."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, last = _Search(least), None
        for (region, deep, ids, sk), begin, end in _runs(batches, SKETCH // 2):
            if last is None:
                search.whole(int(region[0]), ids[: end[0]])
            last = int(region[begin[-1]]), ids[begin[-1] : end[-1]]
            two = begin[end - begin == 2]
            if len(two):  # most regions: one pair
                ok = two[_agreement(sk[two], sk[two + 1]) >= least]
                search.out += list(zip(ids[ok].tolist(), ids[ok + 1].tolist(), region[ok].tolist(), [False] * len(ok)))
            for a, b in zip(begin[end - begin > 2], end[end - begin > 2]):
                search.region(int(region[a]), deep[a:b], ids[a:b], sk[a:b])
            yield from _edges(search.out)
            search.out = []
        if last is not None:
            search.whole(*last)
            yield from _edges(search.out)
        trim()

    return run


def _sets(width: int):
    """(id, names): the sorted shingle names of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                names, starts = shingle_sets(words_of(s, lower=True), width)
                sets = pa.array([names[x:y].tobytes() for x, y in zip(starts, starts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n_docs), sets], ["id", "names"])

    return run


def linked_labels(sets: list[np.ndarray], percent: int, some: np.ndarray | None = None) -> np.ndarray:
    """For each of some distinct sets, the first that it reaches by links between them (given ``some``: by links
    that have one of these at an end)."""
    n, size = len(sets), np.array([len(x) for x in sets])
    some = np.arange(n) if some is None else some
    both = np.zeros((len(some), n), np.float32)
    parts = max(1, -(-int(size.sum()) // ENTRIES))  # ranges of names, so that no more entries are sorted at a time
    edges = np.array([k * (1 << 64) // parts for k in range(1, parts)], U64)
    cuts = np.stack([np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in sets]).astype(np.int64)
    for k in range(parts):
        _, column, count = np.unique(np.concatenate([x[a:b] for x, a, b in zip(sets, cuts[:, k], cuts[:, k + 1])]), return_inverse=True, return_counts=True)
        row, common = np.repeat(np.arange(n), cuts[:, k + 1] - cuts[:, k]), count > 1
        place = np.cumsum(common) - 1
        keep = common[column]
        row, column = row[keep], place[column[keep]]
        for at in range(0, int(common.sum()), 4096):
            here = (column >= at) & (column < at + 4096)
            part = np.zeros((n, 4096), np.float32)
            part[row[here], column[here] - at] = 1
            both += part[some] @ part.T
    linked = (both > 0) & (100 * both >= percent * (size[some, None] + size[None, :] - both))
    linked[np.arange(len(some)), some] = True
    label = np.arange(n)
    while True:
        new = label.copy()
        new[some] = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(new, np.where(linked, new[some, None], n).min(0))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _exact(percent: int):
    """Links (a, b) between different components from rows (region, id, comp, names) sorted by region."""
    def links(rows: list[tuple]) -> list[tuple]:
        comps, of, n = np.unique([r[1] for r in rows], return_inverse=True, return_counts=True)
        if len(comps) < 2:
            return []
        label = linked_labels([np.frombuffer(r[2], U64) for r in rows], percent, np.flatnonzero(of != n.argmax()))
        return [(r[0], rows[k][0]) for r, k in zip(rows, label) if r[1] != rows[k][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, rows = None, []
        for b in batches:
            out = []
            for r, *row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if r != region:
                    out += links(rows)
                    region, rows = r, []
                if not rows or rows[-1][0] != row[0]:
                    rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
            trim()
        if out := links(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        trim()

    return run


def _forest(rows: DataFrame, percent: int) -> DataFrame:
    """``rows``: region, deep, id, sketch."""
    ordered = rows.select("region", "deep", "id", "sketch").repartitionByRange("region", "deep").sortWithinPartitions("region", "deep", "id")
    return ordered.mapInArrow(_candidates(percent), _EDGES)


def _pair_groups(x: pa.Array, y: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are PAIR_BYTES together at most (one row at least)."""
    size = np.cumsum(pa.compute.binary_length(x).to_numpy() + pa.compute.binary_length(y).to_numpy())
    first, done = 0, 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(size, done + PAIR_BYTES, side="right")))
        yield first, last
        first, done = last, int(size[last - 1])


def _linked(x: pa.Array, y: pa.Array, width: int, percent: int) -> list[bool]:
    """Whether texts are linked row by row. Their words and shingles are numbered together, without any hash."""
    both = pa.concat_arrays([x, y]).cast(pa.large_binary())
    (s,) = slices(both, 1 << 62)
    names, starts = shingle_sets(numbered_words(s, lower=True), width, _join_numbers)
    sets, n, out = np.split(names, starts[1:-1]), len(x), []
    for a, b in zip(sets[:n], sets[n:]):
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
    return out


def _check(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).cast(pa.large_binary()) for k in (2, 3))
            for first, last in _pair_groups(x, y):
                part = slice(first, last)
                linked = _linked(x[part], y[part], width, percent)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], pa.array(linked, pa.bool_())], ["a", "b", "linked"])
            trim()

    return run


def _verify(pairs: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) for distinct pairs, compared on the full sets of their texts ``own`` (_row, text)."""
    left = pairs.join(own.select(F.col("_row").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(own.select(F.col("_row").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_check(width, percent), "a long, b long, linked boolean"), "links")


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(members: DataFrame) -> DataFrame:
    """``members`` (region, id, comp, size) of the regions that hold several components, with the largest one (main), the
    chunks that all members (n) and those outside it (few) make, and whether the region is dealt out in chunks (large)."""
    sizes = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).groupBy("region").agg(F.max(F.struct("n", "comp", "b")).alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    chunks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / CHUNK_BYTES)).cast("int")
    sizes = sizes.where("main.n < n").select(
        "region", F.col("main.comp").alias("main"), ((F.col("n") > REGION) | (F.col("b") > REGION_BYTES)).alias("large"),
        chunks(F.col("n"), F.col("b")).alias("n"), chunks(F.col("n") - F.col("main.n"), F.col("b") - F.col("main.b")).alias("few"),
    )
    return materialize(members.join(sizes, "region"), "unlinked")


def _compare(rows: DataFrame, sets: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between components among ``rows`` (region, id, comp), each region in one task."""
    ordered = rows.join(sets, "id").select("region", "id", "comp", "names").repartition("region").sortWithinPartitions("region", "id")
    found = materialize(ordered.mapInArrow(_exact(percent), "a long, b long"), "near-links")
    return _verify(_pairs(found), own, width, percent).where("linked").select("a", "b")


def _all_links(found: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) from the candidates of the forest; spans the components of all links."""
    tested = _verify(_pairs(found), own, width, percent)
    failed = tested.where("NOT linked").select("a", "b")
    spare = found.where("spare AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "region")
    again = spare.join(failed, ["a", "b"]).select("region").unionAll(found.where("a = b AND NOT spare").select("region")).distinct()
    links = tested.where("linked").select("a", "b")
    labels = components(links)
    members = found.where("a = b").select("region", F.col("a").alias("id")).distinct().join(again, "region")
    sizes = own.select(F.col("_row").alias("id"), (4 * F.octet_length("text").cast("long")).alias("size"))  # eight bytes for two of a text at most
    members = members.join(labels, F.col("id") == F.col("node"), "left").select("region", "id", F.coalesce("label", "id").alias("comp")).join(sizes, "id")
    members = _apart(materialize(members, "members"))
    if not members.head(1):
        return links
    sets = materialize(own.join(members.select(F.col("id").alias("_row")).distinct(), "_row", "left_semi").select("_row", "text").mapInArrow(_sets(width), "id long, names binary"), "sets")
    heads = members.where("large").groupBy("region", "comp").agg(F.min_by("size", "id").alias("size"), F.min("id").alias("id"))
    few = heads.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("b")).where((F.col("k") <= REGION) & (F.col("b") <= REGION_BYTES)).select("region")
    joined = _compare(heads.join(few, "region").select("region", "id", "comp"), sets, own, width, percent)
    if joined.head(1):  # pieces of large regions have grown together
        links = materialize(links.unionAll(joined), "grown")
        labels = components(links)
        members = members.select("region", "id", "size").join(labels, F.col("id") == F.col("node"), "left").select("region", "id", F.coalesce("label", "id").alias("comp"), "size")
        members = _apart(members)
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    small, large = members.where("NOT large"), members.where("large")
    # a chunk of the members outside the largest component meets each chunk of all members
    dealt = large.select("region", "id", "comp", each("few").alias("i"), mine("n").alias("j")).unionAll(large.where("comp <> main").select("region", "id", "comp", mine("few").alias("i"), each("n").alias("j")))
    rows = small.select("region", "id", "comp").unionAll(dealt.select(F.xxhash64("region", "i", "j").alias("region"), "id", "comp"))
    return links.unionAll(_compare(rows, sets, own, width, percent))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (_row, doc_id, text): _row, doc_id, n_shingles, component_id, kept."""
    fresh_heaps(docs.sparkSession)
    texts = docs.select("_row", "text")
    signed = materialize(docs.select("_row", F.col("doc_id").cast("long"), "text").mapInArrow(_sign(width), _SIGNED), "signed")
    first = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("_row").alias("rep"))
    reps = first.select(F.col("rep").alias("_row"))
    entries = F.explode(F.arrays_zip("regions", "deeps")).alias("z")
    forest = signed.join(reps, "_row", "left_semi").select(F.col("_row").alias("id"), "sketch", entries)
    found = materialize(_forest(forest.select(F.col("z.regions").alias("region"), F.col("z.deeps").alias("deep"), "id", "sketch"), percent), "candidates")
    needed = found.select(F.col("a").alias("_row")).unionAll(found.select(F.col("b").alias("_row"))).distinct()
    own = materialize(texts.join(needed.hint("merge"), "_row", "left_semi"), "texts")
    fresh_heaps(docs.sparkSession)
    labels = components(_all_links(found, own, width, percent))
    rows = signed.select("_row", "doc_id", "n_shingles", "set_key").join(first, "set_key", "left")
    rows = rows.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("_row"))).join(labels, F.col("rep") == F.col("node"), "left")
    rows = rows.select("_row", "doc_id", "n_shingles", F.coalesce("label", "rep").alias("comp"))
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"))).alias("best"))
    return rows.join(best, "comp").select("_row", "doc_id", "n_shingles", F.col("best.b").alias("component_id"), (F.col("_row") == F.col("best.c")).alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row (the smallest doc_id) of each group, all columns kept."""
    return filtered(docs, lambda d: d.join(near_groups(d, width, percent).where("kept").select("_row"), "_row", "left_semi"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_groups(docs, width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLE = {
    "op5_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.other, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.other, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
}
