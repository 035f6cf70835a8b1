"""Removal of passages that repeat anywhere in a corpus, by overlapping windows of three lines.

A line ends at a newline. A longer line is divided at places that its own words choose: of every WIDTH words in a row, a line ends
after the one that is greatest by its first eight bytes (of equal ones the last). So a passage is divided alike wherever it stands, up to
WIDTH words from its ends, and one of 50 words or more always has four whole lines. Every three consecutive lines are hashed,
repeated hashes are found over all texts, the first occurrence stays, and of the others the lines that any of them covers go, where
these add up to LEAST_WORDS words in a row.

Hashes are packed by range of hash, so that a range is one row for each task and sorted with numpy. What repeats within a task is settled
there: a window that stands in every text is dealt out once for each task, not once for each text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import kernel
from ledgerfold.llm.store import saved, small_batches, unused

#: Words within which a long line is divided once at least; lines of a window; words in a row that are removed at least.
WIDTH, WINDOW, LEAST_WORDS = 8, 3, 20
#: Windows that a task holds before it packs them; bytes of text whose windows make up one range.
HELD, RANGE_BYTES = 1 << 18, 32 << 20

_PLAIN = kernel.lookup("space", lower=False)


class Lines(NamedTuple):
    """``head``: the first word of each line. ``of``: index of each text's first line (one more than texts). ``starts``: whether a newline, or the text's begin, is before it."""

    words: kernel.Words
    head: np.ndarray
    of: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.head, len(self.words.starts)))


def _words(block: kernel.Block) -> kernel.Words:
    """Words between ASCII white space; each character from U+3000 to U+D7FF is a word of its own."""
    w = kernel.words(block, _PLAIN)
    lead = np.flatnonzero((block.data >= 0xE3) & (block.data <= 0xED))
    if not lead.size:
        return w
    after = lead + 3
    after = after[after < len(block.data)]
    after = after[w.norm[after] > 0]
    starts = np.unique(np.concatenate([w.starts, lead, after]))
    whole = w.ends[np.searchsorted(w.starts, starts, side="right") - 1]
    return kernel.Words(w.norm, starts, np.minimum(whole, np.append(starts[1:], len(block.data))), np.searchsorted(starts, block.offsets))


def _greatest(keys: np.ndarray, width: int) -> np.ndarray:
    """Where the greatest of every ``width`` keys in a row stands; of equal ones the last."""
    m, at, have = keys, np.arange(len(keys)), 1
    while have < width:
        step = min(have, width - have)
        up = m[step:] >= m[:-step]
        m, at = np.where(up, m[step:], m[:-step]), np.where(up, at[step:], at[:-step])
        have += step
    return at


def lines_of(block: kernel.Block, width: int = WIDTH) -> Lines:
    w = _words(block)
    n = len(w.starts)
    text = np.repeat(np.arange(len(w.of) - 1), np.diff(w.of))
    row = np.cumsum(block.data == 0x0A, dtype=np.int32)[w.starts] if n else np.empty(0, np.int32)
    first = np.ones(n, bool)
    first[1:] = (row[1:] != row[:-1]) | (text[1:] != text[:-1])
    last = np.append(first[1:], True)[:n]
    if n >= width:
        line = np.cumsum(first)
        within = line[: n - width + 1] == line[width - 1 :]
        last[_greatest(kernel.prefixes(block.data, w.starts, w.ends), width)[within]] = True
    head = np.flatnonzero(np.append(True, last[:-1])) if n else np.empty(0, np.int64)
    return Lines(w, head, np.searchsorted(head, w.of), first[head])


def _window_hashes(lines: Lines, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window, in order, and where each text's begin. A text of fewer lines, but some, has them all as one window."""
    h, size = kernel.hash_spans(lines.words.norm, lines.words.starts, lines.words.ends), lines.size
    one, two = size.astype(kernel.U), ~size.astype(kernel.U)
    for j in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > j)
        x = h[lines.head[some] + j]
        one[some] = one[some] * kernel.STEP + x
        two[some] = kernel.mix(two[some] ^ x)
    (h1, at), (h2, _) = kernel.shingles(kernel.mix(one), lines.of, window), kernel.shingles(two, lines.of, window)
    return h1, h2, at


def _ranks(ids: pa.Array, keys: np.ndarray) -> np.ndarray:
    """The place of each (id, key) among all, null ids first; equal ones share it."""
    order = pc.sort_indices(pa.table({"id": ids, "key": keys}), sort_keys=[("id", "ascending"), ("key", "ascending")], null_placement="at_start").to_numpy()
    s, k = ids.take(pa.array(order)), keys[order]
    alike = pc.fill_null(pc.equal(s[1:], s[:-1]), False).to_numpy(zero_copy_only=False) | (s[1:].is_null().to_numpy(zero_copy_only=False) & s[:-1].is_null().to_numpy(zero_copy_only=False))
    new = np.ones(len(order), bool)
    new[1:] = ~alike | (k[1:] != k[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _settled(h1: np.ndarray, h2: np.ndarray, at: np.ndarray, rank: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first occurrence of each window, sorted by ``h1``, and of those that stand later. ``rank``: places of the texts of some windows."""
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    many = np.append(False, same) | np.append(same, False) if len(order) else np.empty(0, bool)
    pick = order[many]
    place = rank(pick) if pick.size else np.empty(0, np.int64)
    by = np.lexsort((at[pick], place, h2[pick], h1[pick]))
    pick, place = pick[by], place[by]
    new = np.ones(len(pick), bool)
    new[1:] = (h1[pick][1:] != h1[pick][:-1]) | (h2[pick][1:] != h2[pick][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if pick.size else np.empty(0, np.int64)
    stays = np.zeros(len(h1), bool)
    stays[order[~many]] = True
    stays[pick[new]] = True
    return order[stays[order]], pick[(place != place[head]) | (at[pick] != at[pick[head]])]


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> kernel.U(32)) * kernel.U(ranges)) >> kernel.U(32)).astype(np.int64)


def _packed(bucket: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """One row for each bucket (equal ones stand together), with lists of the columns."""
    turn = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    offsets = pa.array(np.append(turn, len(bucket)), pa.int32())
    return pa.record_batch([pa.array(bucket[turn]), *(pa.ListArray.from_arrays(offsets, c) for c in columns.values())], names=["bucket", *columns])


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _marked(ids: pa.Array, keys: np.ndarray, at: np.ndarray, ranges: int, sign: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Windows to remove, dealt by their text; ``sign``: -1 for buckets below 0."""
    bucket = _range(keys.view(kernel.U), ranges)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order] if sign > 0 else -1 - bucket[order]
    return bucket, {"ids": ids.take(pa.array(order)), "keys": pa.array(keys[order]), "at": pa.array(at[order].astype(np.int32))}


def _hashed(ranges: int, window: int, width: int, id_type: pa.DataType):
    def flush(h1: list, h2: list, doc: list, at: list, ids: list, keys: list) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, at, keys = map(np.concatenate, (h1, h2, doc, at, keys))
        ids = pa.concat_arrays(ids)
        places = _ranks(ids, keys)
        first, later = _settled(h1, h2, at, lambda pick: places[doc[pick]])
        take = lambda i: {"ids": ids.take(pa.array(doc[i])), "keys": pa.array(keys[doc[i]]), "at": pa.array(at[i].astype(np.int32))}
        if first.size:
            yield _packed(_range(h1[first], ranges), {"h1": _long(h1[first]), "h2": _long(h2[first])} | take(first))
        if later.size:
            own = take(later)
            bucket, columns = _marked(own["ids"], keys[doc[later]], at[later], ranges, -1)
            none = pa.nulls(len(bucket), pa.int64())
            yield _packed(bucket, {"h1": none, "h2": none} | columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [], [])
        docs = count = 0
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                h1, h2, of = _window_hashes(lines_of(block, width), window)
                doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
                some = slice(block.first, block.last)
                for part, x in zip(held, (h1, h2, doc + docs, np.arange(len(h1)) - of[doc], batch.column(0)[some].cast(id_type), batch.column(2)[some].to_numpy()), strict=True):
                    part.append(x)
                docs, count = docs + block.last - block.first, count + len(h1)
                if count >= HELD:
                    yield from flush(*held)
                    held, docs, count = ([], [], [], [], [], []), 0, 0
        if count:
            yield from flush(*held)

    return run


def _flat(rows: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in rows[name].chunks])


def _met(ranges: int):
    """All windows of a range, from all tasks: those that do not stand first, dealt by their text."""

    def run(rows: pa.Table) -> pa.Table:
        ids, keys, at = _flat(rows, "ids"), _flat(rows, "keys").to_numpy(), _flat(rows, "at").to_numpy()
        if rows["bucket"][0].as_py() >= 0:
            h1, h2 = (_flat(rows, c).to_numpy().view(kernel.U) for c in ("h1", "h2"))
            later = _settled(h1, h2, at, lambda pick: _ranks(ids.take(pa.array(pick)), keys[pick]))[1]
            ids, keys, at = ids.take(pa.array(later)), keys[later], at[later]
        return pa.Table.from_batches([_packed(*_marked(ids, keys, at, ranges, 1))])

    return run


def _by_text(rows: pa.Table) -> pa.Table:
    """The windows to remove of each text."""
    ids, keys, at = _flat(rows, "ids"), _flat(rows, "keys").to_numpy(), _flat(rows, "at").to_numpy()
    rank = _ranks(ids, keys)
    order = np.lexsort((at, rank))
    rank, at = rank[order], at[order]
    new = np.append(True, (rank[1:] != rank[:-1]) | (at[1:] != at[:-1]))
    order, rank, at = order[new], rank[new], at[new]
    head = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    return pa.table({"id": ids.take(pa.array(order[head])), "key": keys[order[head]], "starts": pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), pa.array(at, pa.int32()))})


def repeats(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(id, key, starts) from (id, text, key): the windows, by the line they begin with, that stand elsewhere before."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    id_type = docs.limit(0).select("id").toArrow().schema[0].type
    lists = f"ids array<{kind}>, keys array<long>, at array<int>"
    hashed = small_batches(docs).select("id", "text", "key").mapInArrow(_hashed(ranges, window, width, id_type), f"bucket long, h1 array<long>, h2 array<long>, {lists}")
    later = hashed.groupBy("bucket").applyInArrow(_met(ranges), f"bucket long, {lists}")
    return later.groupBy("bucket").applyInArrow(_by_text, f"id {kind}, key long, starts array<int>")


def _gone(lines: Lines, starts: pa.Array, window: int, least: int) -> np.ndarray:
    """Which lines go: those of all windows that begin at ``starts``, where they add up to ``least`` words in a row."""
    n = len(lines.head)
    given = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(given)), given)
    begin = lines.of[:-1][row] + starts.flatten().to_numpy()
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, np.minimum(begin + window, lines.of[1:][row]), -1)
    gone = np.cumsum(edge)[:n] > 0
    if not gone.any():
        return gone
    head = np.append(True, gone[1:] != gone[:-1])
    head[lines.of[:-1][lines.of[:-1] < n]] = True
    run = np.cumsum(head) - 1
    return gone & (np.bincount(run, weights=lines.size)[run] >= least)


def _without(block: kernel.Block, lines: Lines, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts without the lines that are gone, and where each text's begin.

    What follows a line up to the next goes with it. A newline stays where any of what it ends stays; a text of which all lines go is empty.
    """
    w, data, offsets = lines.words, block.data, block.offsets
    n_lines, size = np.diff(lines.of), len(data)
    text = np.repeat(np.arange(len(n_lines)), n_lines)
    newlines = np.append(np.flatnonzero(data == 0x0A), size)
    begin, last = w.starts[lines.head], w.ends[np.append(lines.head[1:], len(w.starts)) - 1]
    stop = np.minimum(newlines[np.searchsorted(newlines, last)], offsets[1:][text])
    whole = np.flatnonzero(lines.starts)
    row = np.cumsum(lines.starts) - 1
    left = np.logical_or.reduceat(~gone, whole)
    end = np.where(np.append(lines.starts[1:], True), stop, np.append(begin[1:], size))
    edge = np.zeros(size + 2, np.int32)
    part = gone & left[row]
    np.add.at(edge, begin[part], 1)
    np.add.at(edge, end[part], -1)
    # Rows of which nothing is left go with their newline.
    bare = np.flatnonzero(~left)
    before = np.append(-1, newlines)[np.searchsorted(newlines, begin[whole[bare]])] + 1
    np.add.at(edge, np.maximum(before, offsets[:-1][text[whole[bare]]]), 1)
    ends = stop[np.append(whole[1:], len(begin))[bare] - 1]
    np.add.at(edge, np.minimum(ends + 1, offsets[1:][text[whole[bare]]]), -1)
    keep = np.cumsum(edge)[:size] == 0
    lost = np.bincount(text, weights=gone, minlength=len(n_lines))
    # The last row is gone and had no newline: the one before it ends the text now, without its own.
    cut = np.zeros(len(n_lines), bool)
    cut[text[whole[bare]]] |= ends == offsets[1:][text[whole[bare]]]
    if size:
        latest = np.maximum.accumulate(np.where(keep, np.arange(size), -1))
        for i in np.flatnonzero(cut):
            at = latest[offsets[i + 1] - 1]
            if at >= offsets[i] and data[at] == 0x0A:
                keep[at] = False
    for i in np.flatnonzero((lost > 0) & (lost == n_lines)):
        keep[offsets[i] : offsets[i + 1]] = False
    return data[keep], np.append(0, np.cumsum(keep))[offsets]


def _cut(text_at: int, window: int, width: int, least: int, names: list[str]):
    """Replaces the text and appends how many lines it had and lost; the last column has the windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(text_at)):
                rows = batch.slice(block.first, block.last - block.first)
                lines, texts = lines_of(block, width), rows.column(text_at)
                gone = _gone(lines, rows.column(rows.num_columns - 1), window, least)
                lost = np.append(0, np.cumsum(gone))[lines.of]
                if gone.any():
                    data, at = _without(block, lines, gone)
                    made = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
                    texts = pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), made)
                columns = list(rows.columns[:-1])
                columns[text_at] = texts.cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(lines.of)), pa.array(np.diff(lost))], names=[*rows.schema.names[:-1], *names])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, width: int = WIDTH, least_words: int = LEAST_WORDS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """The rows and columns of ``docs`` with repeated windows cut from the text, and ``n_lines`` (with words), ``n_removed``.

    First is the least id (null before all), then the least hash of id and text, then the place in it. Rows that repeat an id and a text
    are one document and treated alike: what stands first in it stays in all of them. A text of which every line with words goes is empty;
    ``least_words`` = 0 removes repeated windows of any size. Null stays null; empty texts have no lines. ``n_lines`` and ``n_removed``
    name the new columns; such columns of ``docs`` are replaced, all others are kept.
    """
    docs = docs.drop(n_lines, n_removed)
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    found = repeats(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("key")), window, width)
    own, other, of, starts = (unused(docs.columns, c) for c in ("key", "key_of", "id_of", "starts"))
    marks = saved(found, "repeats").select(F.col("id").alias(of), F.col("key").alias(other), F.col("starts").alias(starts))
    keyed = small_batches(docs).withColumn(own, key)
    joined = keyed.join(marks, (F.col(own) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(of)), "left")
    kinds = dict(docs.dtypes) | {text_col: "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns)
    texts = [F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*texts, starts).mapInArrow(_cut(docs.columns.index(text_col), window, width, least_words, [n_lines, n_removed]), f"{schema}, `{n_lines}` long, `{n_removed}` long")
