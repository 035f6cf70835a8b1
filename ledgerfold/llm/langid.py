"""Language identification: spans of one language in mixed texts.

Each word has a score for every learned language, from the byte triples in it. The scripts of its letters narrow the languages that may
be meant, and a Viterbi path over the words, with a penalty for each switch, divides the text into spans.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import kernel
from ledgerfold.llm.store import bounded_sample, learned, small_batches

#: Bound of the labelled sample that is fitted.
FIT_ROWS, FIT_CHARS = 12_000, 24_000_000
BUCKETS = 1 << 16
#: Most that one word may speak against a language, and what a switch costs, both in nats.
WORD_LIMIT, SWITCH = 6.0, 18.0
#: Least share of a language's words that a script needs to be one of its own.
OWN_SCRIPT = 0.002

#: Lead bytes of UTF-8 by script, one bit each: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic and Thai, other (E1), kana, Han, Hangul, beyond the basic plane.
_SCRIPT = np.zeros(256, np.uint16)
for _bit, _leads in enumerate([[*range(0x61, 0x7B), *range(0xC3, 0xCA)], [0xCE, 0xCF], range(0xD0, 0xD4), [0xD4, 0xD5], [0xD6, 0xD7], range(0xD8, 0xDC), [0xE0], [0xE1], [0xE3], range(0xE4, 0xEA), range(0xEA, 0xEE), range(0xF0, 0xF5)]):
    _SCRIPT[list(_leads)] |= 1 << _bit
SCRIPTS = 12


#: Classes of code points: letters, and marks, which belong to the letter before them.
LETTER, MARK = 1, 2


@cache
def classes() -> np.ndarray:
    """LETTER, MARK or 0 for each code point."""
    return np.array([{"L": LETTER, "M": MARK}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def words(block: kernel.Block, of: np.ndarray) -> tuple[kernel.Words, np.ndarray]:
    """Runs of letters and marks by their code points, ``of`` as in ``classes``; and for each byte whether a letter begins there."""
    data = block.data
    norm = kernel.LETTER[data]
    letter = (norm > 0) & (data < 0x80)
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b = [wide[lead + j] for j in range(4)]
        low = [x & 0x3F for x in b]
        two, three = b[0] < 0xE0, b[0] < 0xF0
        point = np.where(two, (b[0] & 0x1F) << 6 | low[1], np.where(three, (b[0] & 0x0F) << 12 | low[1] << 6 | low[2], (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
        kind = of[np.minimum(point, len(of) - 1)]
        letter[lead[kind == LETTER]] = True
        sign, size = lead[kind == 0], np.where(two, 2, np.where(three, 3, 4))[kind == 0]
        for j in range(4):
            norm[sign[size > j] + j] = 0
    return kernel.spans(norm, block.offsets), letter


class Model(NamedTuple):
    """``scores``: log of each triple's share, by bucket and language; ``may``: whether a language is a candidate, by script and language; ``classes``: of code points."""

    langs: list[str]
    scores: np.ndarray
    may: np.ndarray
    classes: np.ndarray


def _buckets(norm: np.ndarray) -> np.ndarray:
    """The bucket of each byte with the one before it and the one after; 0 stands for what lies between words."""
    wide = np.concatenate([np.zeros(1, np.uint8), norm, np.zeros(1, np.uint8)]).astype(np.uint32)
    return ((wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _scripts(w: kernel.Words) -> np.ndarray:
    return np.bitwise_or.reduceat(_SCRIPT[w.norm], w.starts) if len(w.starts) else np.empty(0, np.uint16)


def fit(docs: DataFrame, text: Column, lang: Column, key: Column) -> Model:
    """Learns from rows with text and language; a bounded sample of them, by a hash of ``key``."""
    rows = docs.select(text.cast("string").alias("text"), lang.alias("lang"), key.alias("key")).where("text is not null and lang is not null")
    return learned(bounded_sample(rows, F.col("key"), F.col("text"), FIT_ROWS, FIT_CHARS).select("lang", "text"), _fitted)


def _fitted(table: pa.Table) -> Model:
    names, texts, of = np.array(table.column("lang").to_pylist(), object), kernel.whole(table.column("text")), classes()
    langs = sorted(set(names.tolist()))
    counts, used = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), SCRIPTS))
    for block in kernel.blocks(texts):
        w = words(block, of)[0]
        triples, scripts, inside = _buckets(w.norm), _scripts(w), w.norm > 0
        who = np.searchsorted(langs, names[block.first : block.last].astype(str))
        of_byte, of_word = np.repeat(who, np.diff(block.offsets)), np.repeat(who, np.diff(w.of))
        for i in range(len(langs)):
            counts[i] += np.bincount(triples[(of_byte == i) & inside], minlength=BUCKETS)
            used[i] += [np.count_nonzero(scripts[of_word == i] >> b & 1) for b in range(SCRIPTS)]
    share = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    return Model(langs, np.log(share).T.astype(np.float32), (used > OWN_SCRIPT * np.maximum(1, used.sum(axis=1, keepdims=True))).T, of)


def _votes(block: kernel.Block, w: kernel.Words, path: np.ndarray, langs: int) -> np.ndarray:
    """Letters of each language, by text."""
    letters = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    n = len(w.of) - 1
    text = np.repeat(np.arange(n), np.diff(w.of))
    return np.bincount(text * langs + path, weights=letters[w.ends] - letters[w.starts], minlength=n * langs).reshape(n, langs)


def _word_scores(w: kernel.Words, model: Model) -> np.ndarray:
    """By word and language: 0 for the likeliest, down to -WORD_LIMIT."""
    if not len(w.starts):
        return np.zeros((0, len(model.langs)))
    size = (w.ends - w.starts).astype(np.float64)
    triples = _buckets(w.norm)
    out = np.empty((len(size), len(model.langs)))
    for i in range(len(model.langs)):
        run = np.concatenate([[0.0], np.cumsum(model.scores[:, i][triples], dtype=np.float64)])
        out[:, i] = run[w.ends] - run[w.starts]
    out /= np.sqrt(size)[:, None]
    scripts = _scripts(w)
    may = np.zeros(out.shape, bool)
    for b in range(SCRIPTS):
        if (with_it := np.flatnonzero(scripts >> b & 1)).size:
            may[with_it] |= model.may[b]
    none = ~may.any(axis=1)
    out[~may] = -np.inf
    out[none] = 0
    return np.maximum(out - out.max(axis=1, keepdims=True), -WORD_LIMIT)


def _paths(s: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The best language of each word, by text.

    A text whose favourite loses to no other over any run of words by more than half the cost of a switch is in one language: a path
    with k switches has k + 1 runs in others at most, so none is better. Only other texts are gone through word by word, all together.
    """
    n, total = np.diff(of), np.vstack([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)])
    sums = total[of[1:]] - total[of[:-1]]
    best = np.argmax(sums, axis=1) if s.shape[1] else np.zeros(len(n), int)
    path = np.repeat(best, n).astype(np.int16)
    if not len(s) or s.shape[1] < 2:
        return path
    text = np.repeat(np.arange(len(n)), n)
    lift = (4 * WORD_LIMIT * (n.max() + 1)) * np.arange(len(n))
    mixed = np.zeros(len(n), bool)
    favourite = s[np.arange(len(s)), path]
    for i in range(s.shape[1]):
        gain = np.cumsum(s[:, i] - favourite)
        low = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]) - lift[text]) + lift[text]
        over = gain - low > SWITCH / 2
        mixed[text[over]] = True
    some = np.flatnonzero(mixed)
    some = some[np.argsort(-n[some], kind="stable")]
    if not some.size:
        return path
    first, size = of[:-1][some], n[some]
    value, back = np.zeros((len(some), s.shape[1])), np.empty((int(size.sum()), s.shape[1]), np.int16)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    alive = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # texts with more than t words
    own = np.arange(s.shape[1], dtype=np.int16)
    for t in range(int(size[0])):
        k = alive[t]
        v = value[:k]
        top = v.argmax(axis=1)
        switched = v[np.arange(k), top][:, None] - SWITCH
        stay = v >= switched
        back[at[:k] + t] = np.where(stay, own, top[:, None])
        value[:k] = np.where(stay, v, switched) + s[first[:k] + t]
    state = value.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = alive[t]
        path[first[:k] + t] = state[:k]
        state[:k] = back[at[:k] + t, state[:k]]
    return path


_SPANS = "array<struct<start:int,end:int,lang:string>>"


def _label(model: Model):
    langs = pa.array(model.langs, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for block in kernel.blocks(texts, 4 * kernel.BLOCK_BYTES):
                w, letter = words(block, model.classes)
                path = _paths(_word_scores(w, model), w.of) if model.langs else np.zeros(len(w.starts), np.int16)
                letters = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                start, end, n = letters[w.starts], letters[w.ends], np.diff(w.of)
                text = np.repeat(np.arange(len(n)), n)
                votes = _votes(block, w, path, len(langs)) if len(langs) else np.zeros((len(n), 1))
                known = (np.diff(np.concatenate([[0], np.cumsum(letter)])[block.offsets]) > 0) & bool(model.langs)
                top = votes.argmax(axis=1)
                share = votes[np.arange(len(n)), top] / np.maximum(votes.sum(axis=1), 1)
                turn = np.ones(len(path), bool)
                turn[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(turn & known[text]) if len(path) else np.empty(0, int)
                bounds = np.append(np.flatnonzero(turn), len(path)) if len(path) else np.zeros(1, int)
                last = bounds[np.searchsorted(bounds, head, side="right")] - 1 if len(head) else head
                shift = letters[block.offsets[:-1]]
                spans = pa.StructArray.from_arrays([pa.array(start[head] - shift[text[head]], pa.int32()), pa.array(end[last] - shift[text[head]], pa.int32()), langs.take(pa.array(path[head], pa.int64())) if len(langs) else pa.array([], pa.string())], names=["start", "end", "lang"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[head], np.arange(len(n) + 1)), pa.int32()), spans)
                lang = pa.array(np.where(known, np.array([*model.langs, "und"], object)[np.where(known, top, len(langs))], "und"), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(n)), lang, pa.array(np.where(known, share, 0.0)), listed], names=["id", "lang", "score", "spans"])

    return run


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``lang_pred``, ``score`` and ``spans`` (start, end in code points, language).

    ``lang_pred``: the language of most letters, ``und`` for a text that is null or has no letter, or if nothing was learned; ``score``: its
    share of all letters, 0 for ``und``. Ties go to the language first by name. Repeated rows are labelled alike; other columns are not read.
    """
    narrow = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(_label(model), f"id {narrow.schema['id'].dataType.simpleString()}, lang string, score double, spans {_SPANS}")
    return found.select(F.col("id").alias(id_col), F.col("lang").alias("lang_pred"), "score", "spans")
