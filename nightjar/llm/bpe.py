"""Byte-level BPE encoding and decoding (operator 3).

``encode`` turns a text column into token ids, ``decode`` turns ids back into
raw bytes, ``round_trip`` does both.  They run the tiktoken library over a local rank
file inside ``mapInArrow``.  A long text is first cut so that the library's regular
expression never sees more than about a hundred thousand characters, and no long
run of white space, whose look-ahead would overflow its stack:

* Cuts go before white space that follows a visible character, between a letter
  and a digit or a mark of punctuation behind it, and between a digit and a
  letter.  No alternative of the pattern has both characters of such a place, so
  a match of the uncut text ends there; and what follows sees the same text as
  before, so the ids are those of the uncut text.  A run without such a place
  (letters only, marks only) is one match, which the pattern takes as a whole.
* Of a run of white space ``\\s+(?!\\S)`` takes everything at the end of the
  text, otherwise all but the last character, as one match.  A run of RUN
  characters or more is encoded as that match, without the regular expression.

This holds for the pattern of ``public_tokenizers`` (a run of letters, digits or
other marks, each with one leading space, contractions, and white space).

Defined results: a null text encodes as the empty text (no ids, no bytes);
null ids decode to no bytes; white space of any length and texts without any
are encoded whole; repeated rows and extra columns pass through ``encode``
unchanged, except that an existing column with the output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textnp import trim

#: Characters a piece of a long text has at least, before the next safe boundary.
PIECE_CHARS = 100_000
#: White-space characters of a run, in long texts, that are encoded as the match they are.
RUN = 4096
#: Rows that go through the library between two Arrow batches of output.
ROWS = 512
# The characters of Unicode's White_Space, and letters and marks that have been such since early versions.
_SPACE = "\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_LETTER = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u0410-\u044F\u05D0-\u05EA\u0621-\u063A\u0E01-\u0E30\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
_MARK = "!-&(-/:-@\\[-`{-~\u3001\u3002\u300C-\u300F\uFF01\uFF0C\uFF1A\uFF1B\uFF1F"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}])")


@lru_cache(maxsize=4)
def load_encoding(ranks: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; one for each worker process."""
    import tiktoken

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def pieces(text: str, size: int | None = None, run: int | None = None) -> Iterator[tuple[str, bool]]:
    """Cut a text at safe boundaries at least ``size`` characters apart and around long runs of white space; the second
    value tells whether a piece is one match as it stands."""
    size, run = size or PIECE_CHARS, run or RUN
    at = 0
    for m in re.finditer(f"[{_SPACE}]{{{run},}}", text):
        yield from ((x, False) for x in _cut(text[at : m.start()], size))
        at = m.end() if m.end() == len(text) else m.end() - 1
        yield text[m.start() : at], True
    yield from ((x, False) for x in _cut(text[at:], size))


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:]


def encode_text(encoding, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    for piece, whole in pieces(text):
        out += encoding._encode_single_piece(piece) if whole else encoding.encode_ordinary(piece)
    return out


@lru_cache(maxsize=4)
def _tokens(ranks: str, pattern: str) -> list[bytes]:
    """The bytes of every token id."""
    known = load_encoding(ranks, pattern)._mergeable_ranks
    by_id = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        by_id[rank] = token
    return by_id


def _ids(texts: pa.Array, ranks: str, pattern: str) -> pa.ListArray:
    encoding = load_encoding(ranks, pattern)
    ids = [np.asarray(encode_text(encoding, t.as_py() or ""), np.int32) for t in texts]
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _bytes(ids: pa.ListArray, ranks: str, pattern: str) -> pa.Array:
    by_id = _tokens(ranks, pattern)
    return pa.array([b"".join(map(by_id.__getitem__, x.values.to_pylist())) if x.is_valid else b"" for x in ids], pa.binary())


_IDS = T.ArrayType(T.IntegerType(), False)


def _added(df: DataFrame, kept: list[str], column: str, outputs: dict[str, T.DataType], make) -> DataFrame:
    """The columns ``kept`` of ``df`` and those that ``make`` derives from ``column``, by ROWS rows at a time."""
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t, False) for n, t in outputs.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *make(b.column(len(kept)))], [*kept, *outputs])
            trim()

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_of")).mapInArrow(run, schema)


def encode(df: DataFrame, ranks: str, pattern: str, column: str = "text", output: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``column`` as an array<int> column ``output``.

    The text column itself is dropped (select it beside the ids by a join if it is needed);
    ``ranks`` is a rank file that every executor has at that path.
    """
    kept = [c for c in df.columns if c not in (column, output)]
    return _added(df, kept, column, {output: _IDS}, lambda texts: [_ids(texts, ranks, pattern)])


def decode(df: DataFrame, ranks: str, pattern: str, column: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of the token ids in ``column`` as a binary column ``output``
    (bytes, as ids may end inside a character).  The ids stay."""
    kept = [c for c in df.columns if c != output]
    return _added(df, kept, column, {output: T.BinaryType()}, lambda ids: [_bytes(ids, ranks, pattern)])


def round_trip(df: DataFrame, ranks: str, pattern: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass, so that a task keeps one Python worker instead of two and ids go to the JVM once."""

    def both(texts: pa.Array) -> list[pa.Array]:
        found = _ids(texts, ranks, pattern)
        return [found, _bytes(found, ranks, pattern)]

    kept = [c for c in df.columns if c not in (column, ids, decoded)]
    return _added(df, kept, column, {ids: _IDS, decoded: T.BinaryType()}, both)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode and decode ``docs`` and reduce both to counts and digests, one row per document."""
    both = round_trip(docs.select("doc_id", "text"), ranks, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return digests(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


QUERIES = {"op3_bpe": op3_bpe}
ORACLE = {}
