import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from nightjar.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["a b " * 50_000, "x" * 250_000, (" \n" * 40 + "word  two three ") * 4000, "é ñ 12 's " * 30_000, "第一，我们。" * 40_000, "a\n" * 120_000, "don't we'll 3's a1b2 'x'sa " * 9000]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_do_not_change_the_ids(reference, text):
    parts = list(bpe.pieces(text, 1000))
    assert "".join(p for p, _ in parts) == text and len(parts) > (1 if text[:2] != "xx" else 0)
    out = []
    for piece, _ in parts:
        out += reference.encode_ordinary(piece)
    assert out == reference.encode_ordinary(text)


def test_random_texts_in_small_pieces(reference, monkeypatch):
    """Every kind of boundary, with cuts wherever they are allowed and short runs taken as matches."""
    import random

    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "Z", "é", "字", "ا", "ก", "7", "٣", "'", "'s", "'re", ".", "，", "-", "\u0301", "😀", "ˈ"]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 1)
    monkeypatch.setattr(bpe, "RUN", 3)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) * rng.choice((1, 1, 1, 2, 5)) for _ in range(rng.randrange(1, 25)))
        assert bpe.encode_text(reference, text) == reference.encode_ordinary(text), text


def merged(data, ranks):
    """Plain byte-pair merging of one match: again and again the leftmost pair of the least rank."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


SPACES = "\x09\x0a\x0b\x0c\x0d\x20\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


@pytest.mark.parametrize("space", SPACES)
def test_runs_of_white_space(reference, monkeypatch, space):
    """Two million of each kind, before a word, behind one, and alone; shorter runs against plain merging."""
    for text in (space * 2_000_000, "word" + space * 2_000_000, space * 2_000_000 + "word", "x" + space * 1_000_000 + " y"):
        ids = bpe.encode_text(reference, text)
        assert reference.decode_bytes(ids) == text.encode()
    ranks = reference._mergeable_ranks
    monkeypatch.setattr(bpe, "PIECE_CHARS", 10)
    monkeypatch.setattr(bpe, "RUN", 20)
    n = 300
    for tail in ("", "word"):
        text = space * n + tail
        if not tail:
            want = merged(text.encode(), ranks)
        else:
            last = [space.encode() + b"word"] if space == " " else [space.encode(), b"word"]
            want = merged((space * (n - 1)).encode(), ranks) + [i for p in last for i in merged(p, ranks)]
        assert bpe.encode_text(reference, text) == want


@pytest.mark.parametrize("text", ["-" * 1_000_000, "9" * 1_000_000, "字" * 700_000, "\n\t " * 700_000 + "x", "é" * 1_000_000, "'" * 1_000_000])
def test_long_texts_of_one_kind(reference, text):
    assert reference.decode_bytes(bpe.encode_text(reference, text)) == text.encode()


def test_round_trip(odd_docs, odd_rows, reference):
    out = bpe.decode(bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_row", "name", "found", "ids", "decoded"]
    once = bpe.round_trip(odd_docs, RANKS, P.PATTERN)
    assert once.schema == out.schema and sorted(map(repr, once.collect())) == sorted(map(repr, out.collect()))
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    for d, t in odd_rows:
        assert list(got[d]["ids"]) == reference.encode_ordinary(t or "")
        assert bytes(got[d]["decoded"]) == (t or "").encode()


def test_digests(odd_docs, odd_rows, reference, no_docs):
    rows = bpe.digests(odd_docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(odd_rows) + 3
    texts = dict(odd_rows)
    for r in rows:
        if r["doc_id"] is not None:
            ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0


def test_special_strings_are_plain_text(spark, reference):
    df = spark.createDataFrame([(1, "<|endoftext|> x")], "doc_id long, text string")
    assert list(bpe.encode(df, RANKS, P.PATTERN).first()["ids"]) == reference.encode_ordinary("<|endoftext|> x")
