"""Token counts by a two-tier lookup on the map side (operator 11).

No token of a tokenizer that drops white space crosses white space, so the number
of tokens of a text is the sum over its pre-tokens, the runs between white space.

* First tier: the lengths (in tokens) of the frequent pre-tokens, broadcast as one compact
  table of at most ENTRIES entries of ENTRY_CHARS characters, two megabytes or so at any size
  of the corpus.  A worker builds its hash table from it once.  The frequent ones are
  found over all texts: every task keeps a Misra-Gries summary of ENTRIES counters,
  and the summaries, one bounded row a task, are merged 64 to one until one is left.
  It holds every pre-token that makes up more than 1 / ENTRIES of all.
* Second tier: a pre-token that the table lacks is encoded by the tokenizers library and
  kept in the worker's cache of CACHE_ENTRIES entries (CACHE_CHARS characters at most each).
  Where the file splits by SPLIT after lower-casing, a pre-token of printable ASCII without an apostrophe and of the
  letters of Latin-1 (which NFC leaves alone) is first taken apart as that pattern does (runs of letters, single digits, runs of marks), and its parts are looked up; a
  part needs the library's merges only, not its normalisation.

No pre-token is shuffled; which ones are frequent only decides about time, never about
a count.  Long texts are cut at white space, about PART_CHARS characters at a time; a
run without white space is one pre-token and encoded whole.

Defined results: a null text has 0 bytes and 0 tokens, as an empty or blank one; strings of
special tokens inside a text count as the library counts them by default (one token each);
null ids, repeated rows and ties give a row each; columns other than ``doc_id`` and ``text``
are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, table
from .textnp import trim

#: Entries of the broadcast table and counters of a summary, and characters of an entry at most.
ENTRIES, ENTRY_CHARS = 32_768, 64
#: Entries of a worker's cache, and characters of one at most.
CACHE_ENTRIES, CACHE_CHARS = 131_072, 256
#: Summaries that one task merges.
FAN = 64
#: Characters of a long text that are split at a time.
PART_CHARS = 1_000_000
#: Tokens from which a text is over the limit of a context window.
LIMIT = 2048
#: str.split() also splits at these four, which are not white space to the library.
_CONTROLS = re.compile("[\x1c-\x1f]")
# Fixed value: the pattern of the .json file whose matches are the pre-tokens, after NFC and lower-casing.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII without apostrophes and the letters of Latin-1, and what SPLIT does to them in lower case.
_PRINTABLE = re.compile("[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_PARTS = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
_SURE_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def parts(text: str, size: int | None = None) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut before white space."""
    size, at = size or PART_CHARS, 0
    while len(text) - at > size and (m := _SURE_SPACE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def pre_tokens(part: str) -> list[str]:
    """The runs between white space."""
    return [x for x in _SURE_SPACE.split(part) if x] if _CONTROLS.search(part) else part.split()


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json file without truncation and padding; one for each process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    whole, apart = ([tokenizer.encode(x, add_special_tokens=False).ids for x in y] for y in (["one \t two\n3 "], ["one", "two", "3"]))
    if whole[0] != [i for ids in apart for i in ids]:
        raise ValueError(f"{path}: white space matters to this tokenizer, so that lengths of words do not add up")
    return tokenizer


def splits_by(tokenizer, pattern: str = SPLIT) -> bool:
    """Whether the tokenizer's file says: NFC, white space to blanks, lower case, then the matches of ``pattern``, each byte by byte."""
    said = json.loads(tokenizer.to_str())
    normal, split = ((said.get(k) or {}) for k in ("normalizer", "pre_tokenizer"))
    first, *more = split.get("pretokenizers") or [{}]
    return (
        [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and (first.get("type"), first.get("pattern"), first.get("invert"), first.get("behavior")) == ("Split", {"Regex": pattern}, True, "Removed")
        and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in more] == [("ByteLevel", False, False)]
    )


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast entries, and a bounded cache of others behind them."""

    def __init__(self, tokenizer, tokens: list[str], lengths: list[int]) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(zip(tokens, lengths, strict=True))
        self.encode, self.merge, self.cache = tokenizer.encode, tokenizer.model.tokenize, {}
        # what the vocabulary writes for the bytes of a letter; ASCII stands for itself
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.plain, self.special = splits_by(tokenizer), tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, token: str) -> int:
        n = self.cache.get(token)
        if n is None:
            if not self.plain or not _PRINTABLE.fullmatch(token) or any(x in token for x in self.special):
                n = len(self.encode(token, add_special_tokens=False).ids)
            else:
                taken = _PARTS.findall(token.lower())
                n = len(self.merge(token.translate(self.bytes))) if taken == [token] else sum(map(self.__getitem__, taken))
            if len(token) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[token] = n
        return n

    def of(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, pre_tokens(p))) for p in parts(text))


def reduced(counts: Counter, entries: int) -> Counter:
    """A Misra-Gries summary cut to ``entries`` counters: the count of the next one is taken off each."""
    if len(counts) <= entries:
        return counts
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    off = ranked[entries][1]
    return Counter({t: n - off for t, n in ranked[:entries] if n > off})


_SUMMARY = "tokens array<string>, counts array<long>"


def _row(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["tokens", "counts"])


def _summary(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                for p in parts(text.as_py() or ""):
                    counts.update(pre_tokens(p))
                    if len(counts) > 4 * entries:
                        counts = reduced(Counter({t: n for t, n in counts.items() if len(t) <= ENTRY_CHARS}), entries)
        counts = Counter({t: n for t, n in counts.items() if len(t) <= ENTRY_CHARS})
        if counts:
            yield _row(reduced(counts, entries))
        trim()

    return run


def _merged(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for tokens, numbers in zip(b.column(0), b.column(1), strict=True):
                for t, n in zip(tokens.as_py(), numbers.as_py(), strict=True):
                    counts[t] += n
                counts = reduced(counts, entries)
        if counts:
            yield _row(counts)

    return run


def frequent(texts: DataFrame, entries: int = ENTRIES) -> list[str]:
    """At most ``entries`` frequent pre-tokens of the only column of ``texts``, the most frequent first."""
    rows = materialize(texts.mapInArrow(_summary(entries), _SUMMARY), "summaries")
    while (n := rows.count()) > 1:
        older, rows = rows, materialize(rows.repartition(-(-n // FAN)).mapInArrow(_merged(entries), _SUMMARY), "summaries")
        discard(older)
    last = rows.first()  # one row of ``entries`` entries at most
    discard(rows)
    return [] if last is None else [t for t, _ in sorted(zip(last["tokens"], last["counts"], strict=True), key=lambda x: (-x[1], x[0]))]


_BUILT: dict[str, Lengths] = {}


def _lengths(path: str, key: str, compact: tuple[str, bytes]) -> Lengths:
    """The hash table of the broadcast entries; one for each worker process."""
    if key not in _BUILT:
        names, numbers = compact
        n = len(numbers) // 2
        _BUILT.clear()
        _BUILT[key] = Lengths(load(path), names.split("\n")[:n], np.frombuffer(numbers, np.int16).tolist())
    return _BUILT[key]


def count(docs: DataFrame, path: str, column: str = "text", entries: int = ENTRIES) -> DataFrame:
    """``docs`` without ``column``, with ``n_bytes`` (UTF-8) and ``n_tokens`` of it (columns of those names are replaced).

    ``path`` is a .json file of the tokenizers library that driver and executors have at that place; a
    tokenizer to which white space matters is refused.
    """
    tokens = frequent(docs.select(F.col(f"`{column}`").alias("_text")), entries)
    encode = load(path).encode
    lengths = np.array([len(encode(t, add_special_tokens=False).ids) for t in tokens], np.int16)
    names = "\n".join(tokens)  # white space stands in no pre-token
    key = hashlib.sha256(f"{path}\n{names}".encode()).hexdigest()
    compact = docs.sparkSession.sparkContext.broadcast((names, lengths.tobytes()))
    kept = [c for c in docs.columns if c not in (column, "n_bytes", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _lengths(path, key, compact.value).of
        for b in batches:
            counts = pa.array([of(t.as_py()) for t in b.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], b.column(len(kept) + 1), counts], [*kept, "n_bytes", "n_tokens"])
        trim()

    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text.alias("_of"), F.octet_length(text).cast("long").alias("_bytes"))
    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")]))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    found = count(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLE = {}
