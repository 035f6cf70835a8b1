"""Toxicity by multiple-instance learning.

Only documents have labels, but sentences are what offends. A document is toxic if any of its sentences is: its probability is the
noisy-or of theirs, and the weights of a sentence's features are fitted through it. The sentences that carry the score can be located.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import kernel
from ledgerfold.llm.store import labelled_sample, learned, small_batches

#: Bound of the labelled sample that is fitted.
FIT_ROWS, FIT_CHARS = 16_000, 30_000_000
BUCKETS = 1 << 20
#: A word's prefixes of so many bytes are features too, for forms that were never seen.
PREFIXES = (4, 5, 6)
#: A feature takes part if it is in so many toxic documents and so much likelier there.
LEAST_TOXIC, LEAST_LIFT = 3, 3.0
EPOCHS, RATE, L2 = 300, 0.2, 2e-4
#: Least sentence probability that ``offending`` names.
OFFENDING = 0.2

#: Bytes that end a sentence: newline, ! . and ?
_STOPS = np.zeros(256, bool)
_STOPS[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Model(NamedTuple):
    """``slots``: the weight's place for each bucket, or -1; ``weights``: of features; ``bias``: of a sentence without any."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


class Parsed(NamedTuple):
    """Features (bucket, sentence) and sentences (text, first and end byte) of a block."""

    bucket: np.ndarray
    of_feature: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _parse(block: kernel.Block) -> Parsed:
    """A sentence runs to a stop; those without a word are left out."""
    w = kernel.words(block, kernel.ALNUM)
    stops = np.concatenate([[0], np.cumsum(_STOPS[block.data])])
    n = np.diff(w.of)
    text = np.repeat(np.arange(len(n)), n)
    piece = stops[w.starts]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(piece)) - 1 if len(head) else head
    size = w.ends - w.starts
    shift = np.uint64(64 - 20)
    buckets, owners = [kernel.hash_spans(w.norm, w.starts, w.ends) >> shift], [sentence]
    for p in PREFIXES:
        long = np.flatnonzero(size > p)
        buckets.append(kernel.mix(kernel.hash_spans(w.norm, w.starts[long], w.starts[long] + p) ^ np.uint64(p)) >> shift)
        owners.append(sentence[long])
    return Parsed(np.concatenate(buckets).astype(np.int64), np.concatenate(owners), text[head], w.starts[head], w.ends[last] if len(head) else head)


def _sentence_logits(p: Parsed, m: Model) -> np.ndarray:
    """Each feature counts once a sentence."""
    slot = m.slots[p.bucket]
    pick = np.flatnonzero(slot >= 0)
    key = np.unique(p.of_feature[pick] * np.int64(len(m.weights) + 1) + slot[pick])
    return m.bias + np.bincount(key // (len(m.weights) + 1), weights=m.weights[key % (len(m.weights) + 1)], minlength=len(p.text)) if len(p.text) else np.zeros(0)


def _noisy_or(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) for each of ``n`` texts; 0 without sentences."""
    return -np.expm1(-np.bincount(text, weights=np.logaddexp(0, logits), minlength=n)) if n else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from labelled documents (0 or 1); a bounded sample of them, by a hash of the key."""
    return learned(labelled_sample(docs, labels, text, key, label, FIT_ROWS, FIT_CHARS).select("key", "y", "text"), _fitted)


def _fitted(table: pa.Table) -> Model:
    table = table.sort_by("key")
    y, texts = table.column("y").to_numpy().astype(np.float64), kernel.whole(table.column("text"))
    toxic, other = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    # Texts are parsed twice, so that only features that take part are held.
    for block in kernel.blocks(texts):
        first, last, p = block.first, block.last, _parse(block)
        pairs = np.unique(p.text[p.of_feature] * np.int64(BUCKETS) + p.bucket)
        is_toxic = y[first:last][pairs // BUCKETS] == 1
        toxic += np.bincount(pairs[is_toxic] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        other += np.bincount(pairs[~is_toxic] % BUCKETS, minlength=BUCKETS).astype(np.int32)
    n_toxic, n_other = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    kept = np.flatnonzero((toxic >= LEAST_TOXIC) & (toxic / n_toxic >= LEAST_LIFT * (other + 0.5) / n_other))
    slots = np.full(BUCKETS, -1, np.int32)
    slots[kept] = np.arange(len(kept))
    feature, owner, text_of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for block in kernel.blocks(texts):
        first, p = block.first, _parse(block)
        slot = slots[p.bucket]
        pick = np.flatnonzero(slot >= 0)
        pair = np.unique(p.of_feature[pick] * np.int64(len(kept) + 1) + slot[pick])
        feature.append(pair % (len(kept) + 1))
        owner.append(pair // (len(kept) + 1) + at)
        text_of.append(p.text + first)
        at += len(p.text)
    feature, owner, text_of = map(np.concatenate, (feature, owner, text_of))
    weights, bias = np.zeros(len(kept)), -8.0
    # Adagrad on the likelihood of the noisy-or.
    seen, seen_bias = np.full(len(kept), 1e-8), 1e-8
    for _ in range(EPOCHS if len(kept) else 0):
        z = bias + np.bincount(owner, weights=weights[feature], minlength=at)
        own = 1 / (1 + np.exp(-z))
        whole = np.clip(_noisy_or(z, text_of, len(y)), 1e-9, 1 - 1e-9)
        # d log-likelihood / dz: -p for clean documents, p * (1 - P) / P for toxic ones.
        g = own * np.where(y == 1, (1 - whole) / whole, -1.0)[text_of]
        gw, gb = np.bincount(feature, weights=g[owner], minlength=len(kept)) / len(y) - L2 * weights, g.sum() / len(y)
        seen += gw**2
        seen_bias += gb**2
        weights += RATE * gw / np.sqrt(seen)
        bias += RATE * gb / np.sqrt(seen_bias)
    if not len(kept):
        rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        bias = float(np.log(rate / (1 - rate))) - 3
    return Model(slots, weights, float(bias))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                p = _parse(block)
                z = _sentence_logits(p, model)
                score = _noisy_or(z, p.text, block.last - block.first)
                chance = 1 / (1 + np.exp(-z))
                hot = np.flatnonzero(chance >= OFFENDING)
                points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                shift = points[block.offsets[:-1]][p.text[hot]]
                spans = pa.StructArray.from_arrays([pa.array(points[p.start[hot]] - shift, pa.int32()), pa.array(points[p.end[hot]] - shift, pa.int32()), pa.array(chance[hot])], names=["start", "end", "score"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(p.text[hot], np.arange(block.last - block.first + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.last - block.first), pa.array(score), listed], names=["id", "score", "offending"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``score`` (0 to 1) and ``offending``, the likeliest sentences (start, end in code points, score).

    Whole texts are read. Null, empty and wordless texts score 0. Repeated rows score alike; other columns are not read.
    """
    narrow = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(_score(model), f"id {narrow.schema['id'].dataType.simpleString()}, score double, offending array<struct<start:int,end:int,score:double>>")
    return found.select(F.col("id").alias(id_col), "score", "offending")
