"""Substring dedup by recompression (operator 9).

A window is ``width`` consecutive words of one document.  A word is removed when
it lies in a window whose word sequence also starts in a document with a smaller
doc_id.

Recompression: every text is rewritten round by round.  The first round names
maximal runs of equal words, the following rounds name pairs: the symbols are
split into left and right ones, and each left symbol followed by a right one
becomes a new symbol.  Run lengths, sides and names depend on the symbols'
content alone and are the same everywhere, so equal substrings get the same
symbols except near their ends.  A symbol's reach is the stretch of words that
its being formed depended on; it is tracked through the rounds.  A symbol whose
reach lies inside a window is therefore found in every occurrence of that
window.

1. Each window is represented by one such symbol, the longest and of these the
   one with the smallest name (windows that contain none, about 3 %, stand for
   themselves).
2. A shuffle by name tells which symbols occur in more than one document.
3. Only windows whose symbol is shared are named themselves; a second shuffle
   finds for each the smallest document that holds it.  That verifies every
   repeat at full width, whatever symbol led to it.
4. The words under the windows found are removed from the texts.

Names are content names rather than dense integers: the rounds then need no
shuffle at all, where dense names would shuffle about nine times the input.  A
symbol's name only selects what is looked at further; two windows count as equal
when two independent 64-bit names of their whole word sequences are both equal,
each made from the words' bytes with a seed of its own.

Names that many documents of one Arrow batch share go into the shuffle once per
batch (or FLUSH_ROWS rows); the other rows already know their result and are
dealt out evenly.  So a passage that a third of all documents hold is not
gathered in one task.

Defined results: a null or empty text has no words; a null doc_id counts as
larger than all others; rows with equal doc_ids never remove from each other;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, with_row_ids
from .textnp import U64, Words, both_words_of, mix, sequence_names, slices, trim, window_starts

WIDTH, ROUNDS, LONG = 50, 8, 10
_FAR = 1 << 40
_LAST = (1 << 63) - 1
#: Rows of a names shuffle: info packs the place, the number of windows, and two flags.
_ROWS = "key long, key2 long, doc long, _row long, info long"
#: Rows among which names are brought down to one before they are shuffled.
FLUSH_ROWS = 400_000
_KNOWN, _WINDOW = 1, 2
#: Most windows of one row: the number has 18 bits of info.
_MOST = (1 << 18) - 1


def _shifted(x: np.ndarray, by: int, fill: int, same: np.ndarray) -> np.ndarray:
    """Each entry's neighbour to the right (by=1) or left (by=-1), ``fill`` at a text's end."""
    out = np.full(len(x), fill, x.dtype)
    if by == 1:
        out[:-1] = np.where(same, x[1:], fill)
    else:
        out[1:] = np.where(same, x[:-1], fill)
    return out


def recompress(name: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, long: int = LONG):
    """Symbols of the last round over words ``name`` of texts ``doc``: (symbol, begin, low, high);
    [low, high) is the reach."""
    sym, begin, _, low, high = _symbols(name, doc, rounds, long)
    return sym, begin, low, high


def _symbols(name: np.ndarray, doc: np.ndarray, rounds: int, long: int = LONG):
    """``recompress`` with each symbol's end: (symbol, begin, end, low, high)."""
    n = len(name)
    sym, begin, end = name, np.arange(n), np.arange(1, n + 1)
    low, high = begin.copy(), end.copy()
    if n:  # runs
        head = np.ones(n, bool)
        head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(head)
        end = np.append(head[1:], n)
        count, begin, doc = end - head, head, doc[head]
        same = doc[1:] == doc[:-1]
        low = np.minimum(begin, _shifted(begin, -1, -_FAR, same))
        high = _shifted(end, 1, _FAR, same)
        sym = np.where(count > 1, mix(sym[head] * U64(3) + count.astype(U64)), sym[head])
    for r in range(1, rounds):
        side = (mix(sym ^ U64((0x9E3779B97F4A7C15 * r) & (2**64 - 1))) & U64(1)).astype(bool)
        open_ = (end - begin) < long
        left, right = side & open_, ~side & open_
        same = doc[1:] == doc[:-1]
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & right[1:] & same
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        after_high, before_low = _shifted(high, 1, _FAR, same), _shifted(low, -1, -_FAR, same)
        new_high = np.where(left, np.maximum(high, after_high), high)
        new_low = np.where(right & ~second, np.minimum(low, before_low), low)
        at = np.flatnonzero(pair)
        sym = sym.copy()
        sym[at] = mix(sym[at] * U64(0xD6E8FEB86659FD93) + sym[at + 1])
        new_low[at] = np.minimum(low[at], low[at + 1])
        end = end.copy()
        end[at] = end[at + 1]
        keep = ~second
        sym, begin, end, low, high, doc = sym[keep], begin[keep], end[keep], new_low[keep], new_high[keep], doc[keep]
    return sym, begin, end, low, high


def representatives(w: Words, width: int, rounds: int = ROUNDS):
    """The representing symbol of every window.

    Returns (window, key): the window's first word and its symbol's key, and the windows that have none.
    A key is smaller the longer its symbol is: 63 less the length in six bits, the name below them.
    """
    n = len(w.name)
    window = np.flatnonzero(window_starts(w.doc_start, width))
    doc = np.repeat(np.arange(len(w.doc_start) - 1), np.diff(w.doc_start))
    sym, begin, end, low, high = _symbols(w.name, doc, rounds)
    sym = (U64(63) - np.minimum(end - begin, 63).astype(U64) << U64(58)) | (sym >> U64(6))
    ok = high - low <= width
    sym, begin, low, high = sym[ok], begin[ok], low[ok], high[ok]
    best = np.full(len(window), np.iinfo(np.uint64).max, U64)
    has = np.zeros(len(window), bool)
    todo, at = np.arange(len(window)), np.searchsorted(begin, window)
    while len(todo):
        more = at < len(begin)
        more[more] = begin[at[more]] < window[todo[more]] + width
        todo, at = todo[more], at[more]
        p = window[todo]
        inside = (low[at] >= p) & (high[at] <= p + width)
        hit, k = todo[inside], at[inside]
        best[hit] = np.minimum(best[hit], sym[k])
        has[hit] = True
        at = at + 1
    return window[has], best[has], window[~has]


def _rows(key, key2, doc, row, place, count, window: bool) -> pa.RecordBatch:
    """Rows of a names shuffle. Of the rows of one name only those that cannot yet tell their result keep it."""
    order = np.lexsort((doc, key2, key) if window else (doc, key))
    key, key2, doc, row, place, count = (x[order] for x in (key, key2, doc, row, place, count))
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    low, high = doc[first][group], doc[np.append(first[1:], len(key)) - 1][group]
    known = (doc > low) if window else (high > low)
    spread = known & ~head
    key = np.where(spread, mix(row.astype(U64) * U64(0x9E3779B97F4A7C15) + place.astype(U64)), key)
    key2 = np.where(spread, U64(0), key2)
    info = (place << 20) | (count << 2) | np.where(known, _KNOWN, 0) | (_WINDOW if window else 0)
    return _batch(key, key2, doc, row, info)


def _batch(key, key2, doc, row, info) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), key2.view(np.int64), doc, row, info)], ["key", "key2", "doc", "_row", "info"])


class _Gathered:
    """Collects rows of a names shuffle over several slices, up to FLUSH_ROWS."""

    def __init__(self, window: bool) -> None:
        self.window, self.parts, self.n = window, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _rows(*(np.concatenate(c) for c in zip(*self.parts)), window=self.window)
        self.parts, self.n = [], 0


def _window_names(both: list[Words], width: int, start: np.ndarray) -> list[np.ndarray]:
    """The two names of the windows that begin at some words."""
    return [sequence_names(w.name, width)[start] for w in both]


def _first_pass(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, docs = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            symbols, alone = _Gathered(window=False), _Gathered(window=True)
            for s in slices(b.column(2)):
                w, other = both_words_of(s)
                text_of = np.repeat(np.arange(s.n_docs), np.diff(w.doc_start))
                window, key, bare = representatives(w, width, rounds)
                if len(window):  # neighbouring windows with one symbol make one row
                    t = text_of[window]
                    new = np.ones(len(window), bool)
                    new[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1) | (t[1:] != t[:-1])
                    at = np.flatnonzero(new)
                    nth = np.arange(len(window)) - np.repeat(at, np.diff(np.append(at, len(window))))
                    at = np.flatnonzero(nth % _MOST == 0)
                    count = np.diff(np.append(at, len(window)))
                    t = t[at]
                    yield from symbols.add(key[at], np.zeros(len(at), U64), docs[s.first + t], rows[s.first + t], window[at] - w.doc_start[t], count)
                if len(bare):
                    t = text_of[bare]
                    yield from alone.add(*_window_names([w, other], width, bare), docs[s.first + t], rows[s.first + t], bare - w.doc_start[t], np.ones(len(bare), np.int64))
            yield from symbols.flush()
            yield from alone.flush()
            trim()

    return run


def _second_pass(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, docs = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            marks = b.column(3)
            found = _Gathered(window=True)
            for s in slices(b.column(2)):
                both = both_words_of(s)
                w = both[0]
                own = marks.slice(s.first, s.n_docs)
                info = own.flatten().to_numpy()
                text = np.repeat(np.arange(s.n_docs), pa.compute.list_value_length(own).to_numpy())
                done = (info & _WINDOW) > 0
                t, place = text[done], info[done] >> 20
                if len(t):  # windows that the first shuffle has settled
                    row = rows[s.first + t]
                    key = mix(row.astype(U64) * U64(0x9E3779B97F4A7C15) + place.astype(U64))
                    yield _batch(key, np.zeros(len(t), U64), docs[s.first + t], row, (place << 20) | _KNOWN | _WINDOW)
                t, place, count = text[~done], info[~done] >> 20, (info[~done] >> 2) & _MOST
                if len(t):
                    start = np.repeat(place + w.doc_start[t], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    t = np.repeat(t, count)
                    yield from found.add(*_window_names(both, width, start), docs[s.first + t], rows[s.first + t], start - w.doc_start[t], np.ones(len(start), np.int64))
            yield from found.flush()
            trim()

    return run


def _cut_words(width: int):
    names = ["_row", "doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                n_words, n_removed, kept = [], [], []
                for text, at in zip(b.column(2), b.column(3)):
                    words = (text.as_py() or "").encode().split()  # splits at the same six bytes
                    gone = 0
                    if at.is_valid:
                        place = at.values.to_numpy()
                        edge = np.zeros(len(words) + width + 1, np.int64)
                        np.add.at(edge, place, 1)
                        np.add.at(edge, place + width, -1)
                        stay = np.cumsum(edge)[: len(words)] == 0
                        gone = len(words) - int(stay.sum())
                    n_words.append(len(words)), n_removed.append(gone)
                    kept.append(b" ".join(compress(words, stay) if gone else words).decode())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names)
            trim()

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (_row, doc_id, text): _row, doc_id, n_words, n_removed and ``kept``, the
    words that stay, joined by one space.

    The whole operator is one plan: the texts are dealt out by row once and that shuffle serves both joins.
    """
    texts = docs.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    by_key = Window.partitionBy("key", "key2")
    info = F.col("info")
    known, window = info.bitwiseAND(F.lit(_KNOWN)) > 0, info.bitwiseAND(F.lit(_WINDOW)) > 0
    symbols = texts.mapInArrow(_first_pass(width, rounds), _ROWS)
    symbols = symbols.withColumn("least", F.min("doc").over(by_key)).withColumn("most", F.max("doc").over(by_key))
    shared = symbols.where(known | F.when(window, F.col("least") < F.col("doc")).otherwise(F.col("least") < F.col("most")))
    marks = shared.groupBy("_row").agg(F.collect_list("info").alias("marks"))
    windows = texts.join(marks, "_row").select("_row", "doc", "text", "marks").mapInArrow(_second_pass(width), _ROWS)
    windows = windows.withColumn("least", F.min("doc").over(by_key)).where(known | (F.col("least") < F.col("doc")))
    places = windows.groupBy("_row").agg(F.collect_list(F.shiftright("info", 20)).alias("places"))
    return texts.join(places, "_row", "left").select("_row", "doc", "text", "places").mapInArrow(_cut_words(width), "_row long, doc_id long, n_words long, n_removed long, kept string").withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE = {
    "op9_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM win) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, (SELECT unnest(range(50)) AS j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
