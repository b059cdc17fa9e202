"""Language identification of words and documents by a linear-chain CRF (operator 7).

A text is a chain of words (runs of letters).  A word's emission score is a sum
of learned weights of hashed features: its prefixes and suffixes, its letter
bigrams and trigrams, and its entry in a lexicon of frequent training words.
Transitions between the languages of neighbouring words are learned with them.
Forward-backward gives every word the posterior of each language given the
whole text, so code-switched text is labelled word by word; a document gets the
language with the largest expected number of words, and that share as score.

Training reads a bounded sample of labelled rows: at most about ``per_language``
rows of each language, chosen by a hash of the id, of each a segment of at most
``SEGMENT`` characters at a hashed place.  Segments of different rows are woven
into chains that switch language now and then.  Everything else is done on all
rows and whole texts: long chains are cut into blocks whose transfer matrices
are multiplied first, so that the result is exactly that of the uncut chain
while memory and the number of steps stay bounded.

Defined results: ``und`` with score 0 for a null text, a text without letters,
or when no labelled row can be learned from; repeated rows give repeated
results; rows with a null id are predicted (held_out null) and never learned
from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textnp import LETTERS, U64, Slice, lowered, mix, slices, trim, words_of

PER_LANGUAGE, SEGMENT = 250, 2000
BUCKETS = 1 << 16
#: Bytes of text that are labelled at a time, and distinct words whose features are made at a time.
SLICE, WORDS = 1 << 19, 4096
CHAIN, STEPS, RATE, PENALTY = 96, 40, 0.5, 1e-4
BLOCK = 128
UNKNOWN = "und"
#: A document is rejected when no language holds this share of its words.
LEAST_SCORE = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


# ---------------------------------------------------------------- features


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code + U64(kind * 0x9E3779B97F4A7C15 % 2**64)) & U64(BUCKETS - 1)).astype(np.int64)


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every feature of the words data[begin:end] (lower case)."""
    n, size = len(begin), end - begin
    rows, buckets, values = [np.arange(n)], [_bucket(name, 1)], [np.ones(n, np.float32)]
    padded = np.zeros(len(data) + 4, np.uint8)
    padded[: len(data)] = data
    for k in range(1, 5):
        at = np.flatnonzero(size >= k)
        for kind, first in ((1 + k, begin[at]), (5 + k, end[at] - k)):
            if kind == 5:  # prefixes of one to three bytes only
                continue
            code = np.zeros(len(at), U64)
            for j in range(k):
                code = (code << U64(8)) | padded[first + j].astype(U64)
            rows.append(at), buckets.append(_bucket(code, kind)), values.append(np.full(len(at), 0.5, np.float32))
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        row = np.repeat(np.arange(n), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        code = np.zeros(len(row), U64)
        for j in range(k):
            code = (code << U64(8)) | padded[place + j].astype(U64)
        rows.append(row), buckets.append(_bucket(code, 10 + k)), values.append((2.0 / count[row]).astype(np.float32))
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    start: np.ndarray
    transition: np.ndarray
    lexicon: np.ndarray  # sorted names of frequent words
    lexicon_weights: np.ndarray  # words x languages: their share of training occurrences
    lexicon_scale: float

    def scores(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Emission scores of words, WORDS of them at a time."""
        out = np.empty((len(begin), len(self.languages)), np.float64)
        for at in range(0, len(begin), WORDS):
            part = slice(at, at + WORDS)
            row, bucket, value = features(data, begin[part], end[part], name[part])
            for k in range(out.shape[1]):
                out[part, k] = np.bincount(row, self.weights[bucket, k] * value, minlength=len(begin[part]))
            out[part] += self.lexicon_scale * _lookup(self.lexicon, self.lexicon_weights, name[part])
        return out


def _lookup(lexicon: np.ndarray, share: np.ndarray, name: np.ndarray) -> np.ndarray:
    out = np.zeros((len(name), share.shape[1]))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, name), len(lexicon) - 1)
        hit = lexicon[at] == name
        out[hit] = share[at[hit]]
    return out


# ---------------------------------------------------------------- chains


def posteriors(emission: np.ndarray, starts: np.ndarray, start: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of each label of each word. ``emission``: scores of the words of all chains,
    end to end; ``starts``: where each chain begins (one more than chains)."""
    total, labels = emission.shape
    if not total:
        return np.zeros((0, labels))
    e = np.exp(emission - emission.max(1, keepdims=True))
    a = np.exp(transition - transition.max())
    size = np.diff(starts)
    n_blocks = -(-size // block)
    first_block = np.cumsum(n_blocks) - n_blocks
    chain = np.repeat(np.arange(len(size)), n_blocks)
    index = np.arange(len(chain)) - first_block[chain]
    begin = starts[:-1][chain] + index * block
    length = np.minimum(block, starts[1:][chain] - begin)
    order = np.argsort(-length, kind="stable")
    begin_s, length_s = begin[order], length[order]
    active = [int(np.searchsorted(-length_s, -t)) for t in range(int(length_s[0]))]  # blocks longer than t
    many = np.flatnonzero(n_blocks > 1)
    initial = np.exp(start - start.max())
    entry = np.empty((len(chain), labels))  # distribution over the label before the block's first word
    leave = np.ones((len(chain), labels))
    head = np.zeros(len(chain), bool)
    head[first_block[size > 0]] = True
    if len(many):  # transfer matrices, then the state at each block's ends
        transfer = np.broadcast_to(np.eye(labels), (len(chain), labels, labels)).copy()
        for t, k in enumerate(active):
            m = transfer[:k] @ a * e[begin_s[:k] + t][:, None, :]
            if t == 0:
                h = head[order[:k]]
                m[h] = (initial * e[begin_s[:k][h]])[:, None, :]
            transfer[:k] = m / m.sum((1, 2), keepdims=True)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        state = np.full((len(many), labels), 1.0 / labels)
        for b in range(int(n_blocks[many].max()) - 1):
            go = np.flatnonzero(n_blocks[many] - 1 > b)
            at = first_block[many[go]] + b
            s = np.einsum("ni,nij->nj", state[go], transfer[back[at]])
            state[go] = s / s.sum(1, keepdims=True)
            entry[at + 1] = state[go]
        state = np.ones((len(many), labels))
        for b in range(int(n_blocks[many].max()) - 1, 0, -1):
            go = np.flatnonzero(n_blocks[many] > b)
            at = first_block[many[go]] + b
            s = np.einsum("nij,nj->ni", transfer[back[at]], state[go])
            state[go] = s / s.sum(1, keepdims=True)
            leave[at - 1] = state[go]
    forward = np.empty((total, labels))
    alpha, head_s = entry[order], head[order]
    for t, k in enumerate(active):
        w = begin_s[:k] + t
        x = alpha[:k] @ a
        if t == 0:
            x[head_s[:k]] = initial
        x *= e[w]
        x /= x.sum(1, keepdims=True)
        alpha[:k] = forward[w] = x
    beta = leave[order]
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        w = begin_s[:k] + t
        x = beta[:k]
        forward[w] *= x
        x = (x * e[w]) @ a.T
        beta[:k] = x / x.sum(1, keepdims=True)
    return forward / forward.sum(1, keepdims=True)


# ---------------------------------------------------------------- training


def _woven(texts: list[tuple[str, np.ndarray]], languages: list[str], rng: np.random.Generator):
    """Chains of CHAIN words made of runs of 8 to 60 words from changing rows: word numbers and labels."""
    runs = []
    for lang, words in texts:
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 61))
            runs.append((languages.index(lang), words[at : at + n]))
            at += n
    order = rng.permutation(len(runs))
    words = np.concatenate([runs[k][1] for k in order])
    labels = np.concatenate([np.full(len(runs[k][1]), runs[k][0]) for k in order])
    n = max(1, len(words) // CHAIN)
    return (words[: n * CHAIN].reshape(n, -1), labels[: n * CHAIN].reshape(n, -1)) if len(words) >= CHAIN else (words[None], labels[None])


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Learn a model from (text, language) rows by AdaGrad on the log-likelihood of the woven chains."""
    languages = sorted({lang for text, lang in rows if lang and any(c.isalpha() for c in text or "")})
    rows = sorted((text, lang) for text, lang in rows if lang in languages and text)
    if not languages:
        return None
    rng, n_labels = np.random.default_rng(seed), len(languages)
    column = pa.array([t for t, _ in rows], pa.string())
    names, spans, per_text, base = [], [], [], 0
    blob: list[np.ndarray] = []
    for s in slices(column):
        w = words_of(s, lower=True, member=LETTERS)
        names.append(w.name), spans.append(np.stack([w.begin, w.end], 1) + base), blob.append(lowered(s.data))
        base += len(s.data)
        per_text += [x for x in np.diff(w.doc_start)]
    name, span, data = np.concatenate(names), np.concatenate(spans), np.concatenate(blob)
    distinct, at, number = np.unique(name, return_index=True, return_inverse=True)
    ends = np.cumsum(per_text)
    texts = [(lang, number[e - n : e]) for (_, lang), n, e in zip(rows, per_text, ends) if n]
    if not texts:
        return None
    words, labels = _woven(texts, languages, rng)
    row, bucket, value = features(data, span[at, 0], span[at, 1], distinct)
    counts = np.zeros((len(distinct), n_labels))
    for lang, w in texts:
        counts[:, languages.index(lang)] += np.bincount(w, minlength=len(distinct))
    frequent = counts.sum(1) >= 3
    share = counts / counts.sum(1, keepdims=True) - 1 / n_labels
    lexical = np.where(frequent[:, None], share, 0)
    weights, start, transition, scale = np.zeros((BUCKETS, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels)), 1.0
    memory = [np.full_like(weights, 1e-3), np.full_like(transition, 1e-3), 1e-3]
    hot = np.zeros((*labels.shape, n_labels))
    np.put_along_axis(hot, labels[..., None], 1, 2)
    pairs = np.zeros((n_labels, n_labels))
    np.add.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    n = words.size
    for _ in range(STEPS):
        score = lexical * scale
        for k in range(n_labels):
            score[:, k] += np.bincount(row, weights[bucket, k] * value, minlength=len(distinct))
        emission = score[words]
        e = np.exp(emission - emission.max(2, keepdims=True))
        a = np.exp(transition - transition.max())
        forward, back = np.empty_like(e), np.empty_like(e)
        x = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        forward[:, 0] = x
        for t in range(1, words.shape[1]):
            x = (x @ a) * e[:, t]
            forward[:, t] = x = x / x.sum(1, keepdims=True)
        y = np.ones_like(x)
        back[:, -1] = y
        for t in range(words.shape[1] - 2, -1, -1):
            y = (y * e[:, t + 1]) @ a.T
            back[:, t] = y = y / y.sum(1, keepdims=True)
        gamma = forward * back
        gamma /= gamma.sum(2, keepdims=True)
        joint = forward[:, :-1, :, None] * a * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        d = (hot - gamma).reshape(-1, n_labels)
        by_word = np.stack([np.bincount(words.ravel(), d[:, k], minlength=len(distinct)) for k in range(n_labels)], 1)
        g = np.stack([np.bincount(bucket, by_word[row, k] * value, minlength=BUCKETS) for k in range(n_labels)], 1) / n - PENALTY * weights
        gt = (pairs - joint.sum((0, 1))) / n - PENALTY * transition
        gs = float((by_word * lexical).sum() / n - PENALTY * scale)
        for m, grad in ((memory[0], g), (memory[1], gt)):
            m += grad * grad
        memory[2] += gs * gs
        weights += RATE * g / np.sqrt(memory[0])
        transition += RATE * gt / np.sqrt(memory[1])
        scale += RATE * gs / memory[2] ** 0.5
    return Model(languages, weights.astype(np.float32), start, transition, distinct[frequent], share[frequent], scale)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded sample: about ``per_language`` rows of each language that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("place")), F.greatest(F.lit(1), F.length("text") - SEGMENT))
    found = usable.where(draw < share[F.col("lang")]).select(F.substring("text", (place + 1).cast("int"), F.lit(SEGMENT)).alias("text"), "lang")
    return [(r["text"], r["lang"]) for r in found.limit(4 * per_language * len(counts)).collect()]


# ---------------------------------------------------------------- prediction


def _has_letter(s: Slice, found: np.ndarray, k: int) -> bool:
    if found[k]:
        return True
    return any(c.isalpha() for c in s.data[s.starts[k] : s.starts[k + 1]].tobytes().decode("utf-8", "replace"))


_ASCII_LETTER = LETTERS & (np.arange(256) < 128)


def label_slice(model: Model | None, s: Slice, with_labels: bool = False) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Language, score and (if asked for) the words' languages of each text of a slice."""
    langs, scores, marks = [UNKNOWN] * s.n_docs, np.zeros(s.n_docs), [[] for _ in range(s.n_docs)]
    w = words_of(s, lower=True, member=LETTERS)
    if model is None or not len(w.name):
        return langs, scores, marks
    _, at, number = np.unique(w.name, return_index=True, return_inverse=True)
    emission = model.scores(lowered(s.data), w.begin[at], w.end[at], w.name[at])[number]
    post = posteriors(emission, w.doc_start, model.start, model.transition)
    total = np.vstack([np.zeros(post.shape[1]), np.cumsum(post, 0)])
    expected = total[w.doc_start[1:]] - total[w.doc_start[:-1]]
    n = np.diff(w.doc_start)
    hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[s.data])])
    sure = hits[s.starts[1:]] > hits[s.starts[:-1]]
    best = expected.argmax(1)
    for k in np.flatnonzero(n):
        if _has_letter(s, sure, k):
            langs[k], scores[k] = model.languages[best[k]], min(1.0, float(expected[k, best[k]] / n[k]))
            if with_labels:
                marks[k] = [model.languages[x] for x in post[w.doc_start[k] : w.doc_start[k + 1]].argmax(1)]
    return langs, scores, marks


def _predict(model: Model | None, with_labels: bool):
    names = ["key", "lang_pred", "score"] + ["labels"] * with_labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1), SLICE):
                langs, scores, marks = label_slice(model, s, with_labels)
                out = [b.column(0).slice(s.first, s.n_docs), pa.array(langs), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(marks, pa.list_(pa.string()))] * with_labels, names)
            trim()

    return run


def drop_rejected(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` (with a column text) without rows whose language is unknown or scores below ``least``; nothing is shuffled."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(place), SLICE):
                langs, scores, _ = label_slice(model, s)
                yield b.slice(s.first, s.n_docs).filter(pa.array((scores >= least) & (np.array(langs) != UNKNOWN)))
            trim()

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", with_labels: bool = False) -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs`` (key: long, text); ``with_labels`` adds the language of each word (run of letters)."""
    schema = "key long, lang_pred string, score double" + ", labels array<string>" * with_labels
    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(_predict(model, with_labels), schema).withColumnRenamed("key", key)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
