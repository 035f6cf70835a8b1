"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network with calibrated probabilities.

Every term has a sparse random index vector that follows from its hash. A term's vector is its own index vector and the sum of those of
its neighbours in the fitted texts. Terms are words and what a text looks like beside its words: runs of signs, words all in capitals,
and a word that repeats the one before it. A document is the mean of its terms' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import kernel
from ledgerfold.llm.store import labelled_sample, learned, small_batches, unused

#: Bound of the labelled sample that is fitted.
FIT_ROWS, FIT_CHARS = 10_000, 20_000_000
#: Terms share vectors beyond so many; dimensions, entries of an index vector that are not 0, neighbours on each side.
TERMS, WIDTH, ENTRIES, REACH = 1 << 15, 48, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 0.01, 1e-4
#: Share of the sample that the network does not see and the temperature is fitted to.
CALIBRATION = 0.2

#: Class of each byte: 0 white space, 1 letters and digits, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[kernel.SPACE == 0] = 0
_CLASS[kernel.ALNUM > 0] = 1
_SIGN = np.where(_CLASS == 2, np.arange(256), 0).astype(np.uint8)
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
#: Terms that stand for a look; each is 0 to 7.
_CAPITALS, _REPEAT, _SIGNS, _PLAIN = 0, 1, 2, 8


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def _index_vectors() -> np.ndarray:
    """ENTRIES entries of +1 or -1 in each term's vector, from the term's number."""
    out, term = np.zeros((TERMS, WIDTH), np.float32), np.arange(TERMS)
    for e in range(ENTRIES):
        h = kernel.mix(term.astype(np.uint64) * np.uint64(ENTRIES) + np.uint64(e + 1))
        out[term, (h % np.uint64(WIDTH)).astype(int)] += np.where(h >> np.uint64(63), 1, -1)
    return out


def _terms(block: kernel.Block) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the block in reading order, and where each text's begin."""
    w = kernel.words(block, kernel.ALNUM)
    h = (kernel.hash_spans(w.norm, w.starts, w.ends) % np.uint64(TERMS - 16)).astype(np.int64) + 16
    capitals = np.concatenate([[0], np.cumsum(_UPPER[block.data])])
    n = np.diff(w.of)
    text = np.repeat(np.arange(len(n)), n)
    loud = (capitals[w.ends] - capitals[w.starts] == w.ends - w.starts) & (w.ends - w.starts > 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    s = kernel.words(block, _SIGN)
    length = s.ends - s.starts
    # Runs of at least two signs by what they begin with; single ones together, but a bar.
    sign = np.where(length > 1, _SIGNS + 1 + (s.norm[s.starts] % 5), np.where(s.norm[s.starts] == ord("|"), _SIGNS, _PLAIN))
    signs_of = np.repeat(np.arange(len(n)), np.diff(s.of))
    at = np.concatenate([w.starts, w.starts[loud], w.starts[again], s.starts])
    term = np.concatenate([h, np.full(loud.sum(), _CAPITALS), np.full(again.sum(), _REPEAT), sign])
    who = np.concatenate([text, text[loud], text[again], signs_of])
    order = np.argsort(at, kind="stable")
    return term[order], np.searchsorted(who[order], np.arange(len(n) + 1))


def _pool(term: np.ndarray, of: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text, and the logarithm of its number of terms; zeros without terms."""
    out = np.zeros((len(of) - 1, WIDTH + 1), np.float32)
    n = np.diff(of)
    some = np.flatnonzero(n)
    if some.size:
        out[some, :WIDTH] = np.add.reduceat(vectors[term], of[:-1][some], axis=0) / n[some][:, None]
        out[:, WIDTH] = np.log1p(n)
    return out


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.maximum(x @ a + b, 0)
    return hidden, hidden @ c + d


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adam on the cross-entropy."""
    rng = np.random.default_rng(9)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            hidden, z = _forward(x[pick], layers)
            g = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
            back = np.outer(g, layers[2]) * (hidden > 0)
            grads = [x[pick].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ g + DECAY * layers[2], np.array([g.sum()])]
            step += 1
            for p, g1, m, v in zip(layers, grads, first, second, strict=True):
                m += 0.1 * (g1 - m)
                v += 0.001 * (g1**2 - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the held-out labels are likeliest."""
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
    return float(min(np.geomspace(0.25, 8, 61), key=loss)) if len(y) else 1.0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Learns from labelled documents (0 or 1); a bounded sample of them, by a hash of the key."""
    return learned(labelled_sample(docs, labels, text, key, label, FIT_ROWS, FIT_CHARS).select("key", "y", "text"), _fitted)


def _neighbourhoods(term: np.ndarray, text: np.ndarray, own: np.ndarray, context: np.ndarray) -> None:
    """Adds to each term's context the index vectors of the terms within REACH of it in the same text."""
    for gap in range(1, REACH + 1):
        near = np.flatnonzero(text[gap:] == text[:-gap])
        for me, other in ((near, near + gap), (near + gap, near)):
            order = np.argsort(term[me], kind="stable")
            who = term[me][order]
            head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.empty(0, int)
            if head.size:
                context[who[head]] += np.add.reduceat(own[term[other][order]], head, axis=0)


def _fitted(table: pa.Table) -> Model:
    table = table.sort_by("key")
    y, texts = table.column("y").to_numpy().astype(np.float64), kernel.whole(table.column("text"))
    own = _index_vectors()
    context, parsed = np.zeros((TERMS, WIDTH), np.float32), []
    for block in kernel.blocks(texts, kernel.BLOCK_BYTES // 4):
        term, of = _terms(block)
        parsed.append((term.astype(np.int32), of))
        _neighbourhoods(term, np.repeat(np.arange(len(of) - 1), np.diff(of)), own, context)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = (own + np.sqrt(ENTRIES) * context / np.maximum(norm, 1e-9)).astype(np.float32)
    x = np.vstack([np.zeros((0, WIDTH + 1), np.float32), *(_pool(t, of, vectors) for t, of in parsed)])
    if not len(y) or len(np.unique(y)) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        flat = [np.zeros((WIDTH + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3))])]
        return Model(vectors, np.zeros(WIDTH + 1), np.ones(WIDTH + 1), flat, 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    held = np.arange(len(y)) % round(1 / CALIBRATION) == 0
    layers = _train(x[~held], y[~held])
    return Model(vectors, mean, spread, layers, _temperature(_forward(x[held], layers)[1], y[held]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                x = (_pool(*_terms(block), model.vectors) - model.mean) / model.spread
                z = _forward(x, model.layers)[1] / model.temperature
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.last - block.first), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["id", "score"])

    return run


def _append_score(model: Model, text_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(model)
        for batch in batches:
            texts = batch.column(text_at)
            found = [b.column(1) for b in score(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), texts], names=["id", "text"])]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(found) if found else pa.array([], pa.float64())], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, named so that no other column has its name: for a filter of rows, without a join back to them. See ``quality`` for the scores."""
    if unused(docs.columns, score_col) != score_col:
        raise ValueError(f"docs have a column {score_col}")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return small_batches(docs).mapInArrow(_append_score(model, docs.columns.index(text_col), score_col), f"{schema}, `{score_col}` double")


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``score``, the probability (0 to 1) that its quality is 1.

    Whole texts are read; null and empty texts have the score of a text without terms. Repeated rows score alike; other columns are not read.
    """
    narrow = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(_score(model), f"id {narrow.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(id_col), "score")
