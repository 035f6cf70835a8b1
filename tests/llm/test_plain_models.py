"""Scores of the fitted operators against plain loops over words, on small texts."""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import kernel, langid, quality, toxicity

TEXTS = {
    "en": "The old house stands by the river and the wind goes through it every evening while we talk about the weather",
    "de": "Das alte Haus steht am Fluss und der Wind geht jeden Abend hindurch, während wir über das schöne Wetter reden",
    "fr": "La vieille maison est près de la rivière et le vent passe à travers chaque soir pendant que nous parlons du temps",
    "ru": "Старый дом стоит у реки и ветер проходит через него каждый вечер пока мы говорим о погоде",
}
ODD = [None, "", "××× 12", "÷", "— “ ” … 😀", "́́", "one — two × three", "ÉTÉ été", "中文字 and English words", TEXTS["de"] + " " + TEXTS["ru"], TEXTS["en"][:60] + "\n" + TEXTS["fr"], "x" * 3000, "naïve café ÷ 2 = ÆØÅ"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(10 * i + j, " ".join(t.split()[j % 5 :]), lang) for i, (lang, t) in enumerate(TEXTS.items()) for j in range(10)]
    made += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string")


def one_hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(kernel.hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_language(text, model):
    of = lambda c: unicodedata.category(c)[0]
    words = ["".join(g) for inside, g in groupby(lower(text or ""), key=lambda c: of(c) in "LM") if inside]
    if not any(of(c) == "L" for c in text or ""):
        return "und", 0.0
    best, back = None, []
    for word in words:
        raw = word.encode()
        around = b"\0" + raw + b"\0"
        scripts = 0
        for b in raw:
            scripts |= int(langid._SCRIPT[b])
        scores = []
        for lang in range(len(model.langs)):
            total = sum(float(model.scores[((around[i] << 16 | around[i + 1] << 8 | around[i + 2]) * 2654435761 % 2**32) >> 16][lang]) for i in range(len(raw)))
            may = any(scripts >> bit & 1 and model.may[bit][lang] for bit in range(langid.SCRIPTS))
            scores.append((total / math.sqrt(len(raw)), may))
        some = any(may for _, may in scores)
        points = [s if may else -math.inf for s, may in scores] if some else [0.0] * len(scores)
        points = [max(p - max(points), -langid.WORD_LIMIT) for p in points]
        if best is None:
            best = points
            continue
        top = max(range(len(best)), key=lambda k: best[k])
        stay = [best[k] >= best[top] - langid.SWITCH for k in range(len(best))]
        back.append([k if stay[k] else top for k in range(len(best))])
        best = [(best[k] if stay[k] else best[top] - langid.SWITCH) + points[k] for k in range(len(best))]
    path = [max(range(len(best)), key=lambda k: best[k])]
    for step in reversed(back):
        path.append(step[path[-1]])
    votes = [0] * len(model.langs)
    for word, lang in zip(words, reversed(path), strict=True):
        votes[lang] += len(word)
    top = max(range(len(votes)), key=lambda k: votes[k])
    return model.langs[top], votes[top] / sum(votes)


def test_languages_word_by_word(spark, rows):
    model = langid.fit(rows, F.col("text"), F.col("lang"), F.col("doc_id"))
    got = {r["doc_id"]: r for r in langid.languages(rows, model).collect()}
    for r in rows.collect():
        lang, score = plain_language(r["text"], model)
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 1e-9, r
    assert [got[1000 + i]["lang_pred"] for i in range(6)] == ["und"] * 6 and got[1002]["score"] == 0.0


def alnum_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text))


def plain_toxicity(text, model):
    clean = 1.0
    for piece in re.split(r"[\n!.?]", text or ""):
        words = [w.encode() for w in alnum_words(piece)]
        if not words:
            continue
        buckets = {one_hash(w) >> 44 for w in words}
        for p in toxicity.PREFIXES:
            buckets |= {int(kernel.mix(np.array([one_hash(w[:p]) ^ p], np.uint64))[0]) >> 44 for w in words if len(w) > p}
        slots = {int(model.slots[b]) for b in buckets if model.slots[b] >= 0}
        clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[s]) for s in slots))))
    return 1 - clean


def test_noisy_or_sentence_by_sentence(spark):
    made = [(i, f"Plain words number {i} stand here. " + ("You awful scoundrel! " if i % 3 == 0 else "") + "And the end is calm?") for i in range(90)]
    made += [(1000 + i, t) for i, t in enumerate([*ODD, "!!!", "awful. awful! scoundrel\nscoundrels"])]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    model = toxicity.fit(docs, docs.where("doc_id < 1000").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    assert len(model.weights) > 3
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    for i, text in made:
        assert abs(got[i] - plain_toxicity(text, model)) < 1e-9, text


def plain_terms(text):
    """(place, term) of words, capitals, repeats and signs."""
    raw = (text or "").encode()
    found, before = [], None
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        word = bytes(b + 32 if 65 <= b <= 90 else b for b in m[0])
        term = one_hash(word) % (quality.TERMS - 16) + 16
        found.append((m.start(), 0, term))
        if len(m[0]) > 1 and all(65 <= b <= 90 for b in m[0]):
            found.append((m.start(), 1, quality._CAPITALS))
        if term == before:
            found.append((m.start(), 2, quality._REPEAT))
        before = term
    for m in re.finditer(rb"[^0-9A-Za-z\x80-\xff \t\n\x0b\x0c\r]+", raw):
        first = m[0][0]
        found.append((m.start(), 3, quality._SIGNS + 1 + first % 5 if len(m[0]) > 1 else quality._SIGNS if first == ord("|") else quality._PLAIN))
    return [t for _, _, t in sorted(found)]


def plain_quality(text, model):
    terms = plain_terms(text)
    x = np.zeros(quality.WIDTH + 1)
    for t in terms:
        x[: quality.WIDTH] += model.vectors[t] / len(terms)
    x[quality.WIDTH] = math.log1p(len(terms))
    x = (x - model.mean) / model.spread
    a, b, c, d = model.layers
    hidden = [max(0.0, sum(x[i] * a[i, j] for i in range(len(x))) + b[j]) for j in range(a.shape[1])]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, c, strict=True)) + d[0]) / model.temperature))


def test_quality_term_by_term(spark):
    made = [(i, f"Good prose number {i} goes on." if i % 2 else f"BUY!!! now {i} {i} ||| $$$ now now") for i in range(80)]
    made += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    model = quality.fit(docs, docs.where("doc_id < 1000").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, model).collect()}
    for i, text in made:
        assert abs(got[i] - plain_quality(text, model)) < 1e-4, text
    assert min(got[i] for i, _ in made if i < 1000 and i % 2) > max(got[i] for i, _ in made if i < 1000 and not i % 2)


def test_words_of_signs_are_none():
    block = next(kernel.blocks(pa.array(["a×b — ñandú", "", "×", "é 日本"])))
    w, letter = langid.words(block, langid.classes())
    texts = [bytes(w.norm[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert texts == ["a", "b", "ñandú", "é", "日本"] and w.of.tolist() == [0, 3, 3, 3, 5]
    assert letter.sum() == 1 + 1 + 5 + 1 + 2
