"""Near-duplicate documents by an LSH forest.

Each distinct shingle set gets a signature of ``trees x depth`` min-hashes. Every tree sorts the sets by its own ``depth`` values, so that
sets with a long common prefix lie side by side; how deep two neighbours agree follows from how crowded their region of the order is.
In each order a set proposes its most alike neighbour. Proposed pairs are confirmed on the full sets; links between these make the first
components. The forest only finds links early: an exact join then compares all sets of different components, so that no link is lost.
Every set has its rarest shingles in it, as many as two sets at the bound cannot differ in all of.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import kernel
from ledgerfold.llm.store import freed, nearby, saved, small_batches
from ledgerfold.operators.graph import components

TREES, DEPTH, SKETCH = 16, 6, 96
#: Neighbours on each side that a row is compared with in each order of the forest; what lies further is left to the exact join.
WINDOW = 16
#: Least share of equal sketch bytes: three and a half standard deviations below a likeness of 0.8.
ALIKE = 0.66
#: Counters (a power of two) by which shingles are ordered from rare to frequent, the parts they are added up in, and pairs looked at in one step.
COUNTERS, PARTS, STEP = 20, 256, 1 << 21
#: Rows of one shingle that a task of the exact join holds; of more, every two of BLOCKS blocks meet by themselves.
CROWD, BLOCKS = 100_000, 16


def _functions(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` min-hash functions."""
    drawn = kernel.mix(np.arange(first, first + 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return drawn[:n].astype(np.uint32) | np.uint32(1), drawn[n:].astype(np.uint32)


_LABELS = _functions(1, TREES * DEPTH)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[kernel.Block, np.ndarray, np.ndarray]]:
    for block in kernel.blocks(texts):
        w = kernel.words(block, kernel.SPACE)
        yield block, *kernel.distinct(*kernel.shingles(kernel.hash_spans(w.norm, w.starts, w.ends), w.of, k))


def _digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes for each set that has members (0 bytes else): two sums of its mixed members, and the size."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if full := len(values):
        some = np.flatnonzero(np.diff(at))
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[some, i] = kernel.mix(np.add.reduceat(kernel.mix(values ^ np.uint64(salt)), at[some]) + np.diff(at)[some].astype(np.uint64))
        assert full == at[-1]
    return out


def _signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """uint32 min-hashes of the sets that have members, one row each."""
    factors, summands = _LABELS
    begin = at[:-1][np.diff(at) > 0]
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), len(factors)), np.uint32)
    step = np.empty_like(x)
    for j in range(len(factors)):
        np.multiply(x, factors[j], out=step)
        np.add(step, summands[j], out=step)
        out[:, j] = np.minimum.reduceat(step, begin)
    return out


def _binary(rows: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A binary value for each row of a two-dimensional byte array."""
    n, width = rows.shape
    made = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
    return made if null is None else pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), made)


def _counted(k: int):
    """How many sets of the partition each counter's shingles are in, in ``PARTS`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for _, values, _ in _sets(batch.column(0), k):
                table += np.bincount((values >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(table))
        if table.any():
            packed = [zlib.compress(part.tobytes(), 1) for part in table.reshape(PARTS, -1)]
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in rows["counts"].to_pylist())
    return pa.table({"part": rows["part"].slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _levels(narrow: DataFrame, k: int) -> np.ndarray:
    """A level for each counter, greater for more frequent ones. Any levels give the same pairs; these keep frequent shingles out of the join."""
    counts = narrow.select("text").mapInArrow(_counted(k), "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary")
    table = np.zeros((PARTS, (1 << COUNTERS) // PARTS), np.int64)
    for part, packed in counts.collect():
        table[part] = np.frombuffer(zlib.decompress(packed), np.int64)
    return (1024 * np.log2(1 + table.ravel())).astype(np.uint16)


def _rarest(values: np.ndarray, at: np.ndarray, levels: np.ndarray, percent: int) -> list[bytes | None]:
    """For each set its rarest shingles in order: two sets at the bound have one of them in common."""
    key = (levels[values >> np.uint64(64 - COUNTERS)].astype(np.uint64) << np.uint64(48)) | (values & np.uint64((1 << 48) - 1))
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = j - i - -(-percent * (j - i) // 100) + 1
        out.append(np.sort(np.partition(key[i:j], min(n, j - i - 1))[:n]).tobytes() if j > i else None)
    return out


def _scan(k: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values, at in _sets(batch.column(1), k):
                size, digest = np.diff(at), _digests(values, at).view(np.uint8)
                sig = np.zeros((len(size), 4 * TREES * DEPTH), np.uint8)
                if len(values):
                    sig[size > 0] = _signatures(values, at).astype(">u4").view(np.uint8)
                ids, hashes = (batch.column(i).slice(block.first, block.last - block.first) for i in (0, 2))
                yield pa.record_batch([ids, hashes, _binary(digest, size == 0), pa.array(size, pa.int64()), _binary(sig, size == 0), pa.array(_rarest(values, at, levels, percent), pa.binary())], names=["id", "text_hash", "node", "n_shingles", "sig", "rare"])

    return run


_ROW = ["tree", "label", "node", "n_shingles", "sketch"]


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for every tree: its label there, and the same sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(n, TREES, 4 * DEPTH)
        sketch = _binary(sig.reshape(n, -1, 4)[:, :SKETCH, 3])
        for t in range(TREES):
            yield pa.record_batch([pa.array(np.full(n, t), pa.int32()), _binary(sig[:, t]), batch.column("node"), batch.column("n_shingles"), sketch], names=_ROW)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _neighbours(percent: int):
    """Over sorted rows: each row's most alike one of the neighbours on both sides that have a common prefix."""

    def best(rows: pa.Table, low: int) -> pa.RecordBatch:
        """The proposals of pairs whose later row is from ``low`` on; a row by the cut between two batches proposes in both."""
        n = rows.num_rows
        tree, size = rows["tree"].to_numpy(), rows["n_shingles"].to_numpy()
        label, sketch = _matrix(rows["label"], 4 * DEPTH), _matrix(rows["sketch"], SKETCH)
        lead = label[:, :4].copy().view(">u4")[:, 0].astype(np.int64) + (tree.astype(np.int64) << 32)
        score, who, nodes = np.full(n, -1.0), np.zeros(n, np.int64), rows["node"].combine_chunks()
        for o in range(1, min(WINDOW, n - 1) + 1):
            i = np.flatnonzero((lead[o:] == lead[:-o]) & (100 * np.minimum(size[o:], size[:-o]) >= percent * np.maximum(size[o:], size[:-o]))) + o
            i = i[i >= low]
            s = (sketch[i] == sketch[i - o]).mean(axis=1)
            i, s = i[s >= ALIKE], s[s >= ALIKE]
            for me, other in ((i, i - o), (i - o, i)):
                up = s > score[me]
                score[me[up]], who[me[up]] = s[up], other[up]
        me = np.flatnonzero(score >= 0)
        pairs = np.unique(np.sort(np.stack([me, who[me]], axis=1), axis=1), axis=0)
        ends = [nodes.take(pa.array(pairs[:, k])).to_pylist() for k in (0, 1)]
        return pa.record_batch([pa.array(x, pa.binary()) for x in (list(map(min, *ends)), list(map(max, *ends)))] if pairs.size else [pa.array([], pa.binary())] * 2, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            seen = held.num_rows if held is not None else 0
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            yield best(rows, seen)
            held = rows.slice(max(0, rows.num_rows - WINDOW))

    return run


def _pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the forest's candidates among ``nodes`` (node, n_shingles, sig), each once."""
    grown = nodes.select("node", "n_shingles", "sig").mapInArrow(_plant, "tree int, label binary, node binary, n_shingles long, sketch binary")
    # A range of labels is as deep a prefix as its region needs: crowded regions are cut finer. Pairs across a cut are left to other trees and the exact join.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "label", "node"]
    return grown.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(percent), "a binary, b binary").distinct()


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values, at in _sets(batch.column(1), k):
                full = np.diff(at) > 0
                keep = pa.array(full)
                sets = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))
                wanted = batch.column(0).slice(block.first, block.last - block.first)
                yield pa.record_batch([wanted.filter(keep), _binary(_digests(values, at).view(np.uint8)).filter(keep), sets.filter(keep)], names=["wanted", "node", "members"])

    return run


_MET = ["key", "of", "short", "n_shingles", "place", "side"]
_MET_TYPES = ", ".join(f"{c} long" for c in _MET)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for every one of its rarest shingles, with the place of that one."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            rows = batch.slice(first, 256)
            keys = [np.frombuffer(x, np.int64) for x in rows.column("rare").to_pylist()]
            n = np.array([len(x) for x in keys])
            places = np.concatenate([np.arange(x) for x in n])
            short, of, size = (np.repeat(rows.column(c).to_numpy(), n) for c in ("short", "of", "n_shingles"))
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(of), pa.array(short), pa.array(size), pa.array(places), pa.array(np.full(len(places), -1))], names=_MET)


def _met(percent: int, crowd: int):
    """Over rows sorted by key and component: all pairs of one key and different components that may still be at the bound.

    Of the shingles that two sets share none comes before the first that both have, so from there on the smaller rest bounds
    their intersection. Other shared ones may fail this; the first of a pair at the bound does not. Rows of a key with ``side`` 0 and 1
    meet those of the other side only. A key of more than ``crowd`` rows is given back as it came.
    """

    def pairs(key: np.ndarray, of: np.ndarray, short: np.ndarray, size: np.ndarray, place: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, row = len(key), np.arange(len(key))
        turn = key[1:] != key[:-1]
        runs, groups = (np.append(np.flatnonzero(x) + 1, n) for x in (turn, turn | (of[1:] != of[:-1])))
        last, begin = runs[np.searchsorted(runs, row, side="right")], groups[np.searchsorted(groups, row, side="right")]
        row = row[last > begin]
        total = np.cumsum(last[row] - begin[row])
        while row.size:
            k = max(1, int(np.searchsorted(total, STEP, side="right")))
            some, count = row[:k], (last - begin)[row[:k]]
            i = np.repeat(some, count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + begin[i]
            both = np.minimum(size[i] - place[i], size[j] - place[j])
            may = ((100 + percent) * both >= percent * (size[i] + size[j])) & ((side[i] < 0) | (side[i] != side[j]))
            a, b = short[i[may]], short[j[may]]
            if a.size:
                found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                none = [pa.nulls(found.shape[1], pa.int64())] * len(_MET)
                yield pa.record_batch([pa.array(found[0]), pa.array(found[1]), *none], names=["a", "b", *_MET])
            row, total = row[k:], total[k:] - total[k - 1]

    def back(rows: list[np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(rows[0]), pa.int64())
        return pa.record_batch([none, none, *map(pa.array, rows)], names=["a", "b", *_MET])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = [np.empty(0, np.int64)] * len(_MET), None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in _MET]
            if crowded is not None and len(rows[0]):
                n = int(np.searchsorted(rows[0], crowded, side="right"))
                if n:
                    yield back([x[:n] for x in rows])
                    rows = [x[n:] for x in rows]
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            # Keys that end here are whole; one of these may be crowded too.
            yield from settled([x[:whole] for x in rows])
            held = [x[whole:] for x in rows]
            if len(held[0]) > crowd:
                crowded = held[0][0]
                yield back(held)
                held = [x[:0] for x in held]
        yield from settled(held)

    def settled(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = rows[0]
        if not len(key):
            return
        begin = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        many = np.repeat(np.diff(np.append(begin, len(key))) > crowd, np.diff(np.append(begin, len(key))))
        if many.any():
            yield back([x[many] for x in rows])
        yield from pairs(*(x[~many] for x in rows))

    return run


def _blocks_of(crowd: DataFrame, turn: int) -> DataFrame:
    """The rows of crowded keys, each for every block that its own meets: two blocks are a key."""
    own, other = F.pmod(F.xxhash64("short", F.lit(turn)), F.lit(BLOCKS)), F.col("other")
    rows = crowd.select(*_MET, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("other"))
    low = F.when(F.col("side") == 1, other).when(F.col("side") == 0, F.col("own")).otherwise(F.least("own", other))
    high = F.when(F.col("side") == 1, F.col("own")).when(F.col("side") == 0, other).otherwise(F.greatest("own", other))
    side = F.when(F.col("side") >= 0, F.col("side")).when(F.col("own") == other, -1).otherwise((F.col("own") > other).cast("int")).cast("bigint")
    return rows.select(F.xxhash64("key", low, high, F.lit(turn)).alias("key"), "of", "short", "n_shingles", "place", side.alias("side"))


def _all_met(rows: DataFrame, percent: int, crowd: int) -> DataFrame:
    """(a, b): pairs of ``_met``, each once; crowded keys go on in blocks until none is left."""
    parts, found, turn = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [], 0
    while True:
        met = small_batches(rows).repartition(parts, "key").sortWithinPartitions("key", "of").mapInArrow(_met(percent, crowd), f"a long, b long, {_MET_TYPES}")
        found.append(saved(met.distinct(), "met"))
        left = found[-1].where("key is not null").select(*_MET)
        if left.isEmpty():
            break
        rows, turn = _blocks_of(left, turn), turn + 1
    every = found[0].where("a is not null").select("a", "b")
    for more in found[1:]:
        every = every.unionByName(more.where("a is not null").select("a", "b"))
    if not turn:
        return every
    once = saved(every.distinct(), "met")
    freed(*found)
    return once


_CLOSE = ["a", "b", "size_a", "size_b", "rare_a", "rare_b"]


def _close(percent: int):
    """The pairs whose rarest shingles leave room for the bound.

    Up to the lesser of both last ones, all that two sets share is known; beyond it, they share no more than the smaller rest.
    """

    def may(size_a: int, size_b: int, rare_a: bytes, rare_b: bytes) -> bool:
        x, y = np.frombuffer(rare_a, np.uint64), np.frombuffer(rare_b, np.uint64)
        last = min(x[-1], y[-1])
        x, y = x[: np.searchsorted(x, last, side="right")], y[: np.searchsorted(y, last, side="right")]
        known = max(np.isin(x, y).sum(), np.isin(y, x).sum())
        return (100 + percent) * (int(known) + min(size_a - len(x), size_b - len(y))) >= percent * (size_a + size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may(*r) for r in zip(*(batch.column(c).to_pylist() for c in _CLOSE[2:]), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(rare: DataFrame, early: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of ``rare`` (node, n_shingles, rare) in different components of ``early`` that may be at the bound, each once."""
    short = F.xxhash64("node")
    placed = rare.join(early, "node", "left").select(short.alias("short"), F.xxhash64(F.coalesce("component", "node")).alias("of"), "n_shingles", "rare")
    met = _all_met(small_batches(placed).mapInArrow(_spread, _MET_TYPES), percent, CROWD)
    ends = saved(met.select(F.explode(F.array("a", "b")).alias("short")).distinct(), "ends")
    held = saved(rare.withColumn("short", short).join(nearby(ends, ends.count()), "short"), "held")
    one, two = (held.select(F.col("short").alias(f"short_{c}"), F.col("node").alias(c), F.col("n_shingles").alias(f"size_{c}"), F.col("rare").alias(f"rare_{c}")) for c in "ab")
    both = met.select(F.col("a").alias("short_a"), F.col("b").alias("short_b")).join(one, "short_a").join(two, "short_b").select(*_CLOSE)
    found = saved(both.mapInArrow(_close(percent), "a binary, b binary"), "apart")
    freed(met, ends, held)
    return found


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _members(narrow: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(node, members) of the sets in ``pairs``, from the text of one row of each."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(F.col("node").alias("wanted"), F.col("row.id").alias("of"), F.col("row.text_hash").alias("of_hash")), "wanted")
    rows = nearby(wanted, wanted.count())
    texts = narrow.join(rows, (narrow["text_hash"] == rows["of_hash"]) & narrow["id"].eqNullSafe(rows["of"])).select("wanted", "text")
    found = saved(texts.mapInArrow(_full(k), "wanted binary, node binary, members array<bigint>").where("wanted = node").select("node", "members").dropDuplicates(["node"]), "sets")
    freed(wanted)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, keyed: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Words split at ASCII white space with A-Z lower-cased; a set holds the distinct ``k``-word shingles of the whole text, or its
    whole sequence where it has fewer words. Sets whose intersection is at least ``percent`` hundredths of their union are linked;
    ``component_id`` is the least id reachable and ``kept`` marks it. Texts without words (null, empty, blank) are linked with nothing
    and are their own component. ``keyed``: with ``text_hash``, the xxhash64 of the row's text, and ``group``, null for texts without words: groups of one ``component_id`` differ in it. Rows with a null id take part: their component is the least id that is not null, or null.
    Repeated rows share a component; a repeated id is kept each time. Other columns of ``docs`` are not read.
    """
    narrow = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    signed = saved(narrow.mapInArrow(_scan(k, percent, _levels(narrow, k)), f"id {kind}, text_hash long, node binary, n_shingles long, sig binary, rare binary"), "signatures")
    # Equal sets have equal signatures: one of each goes on.
    groups = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_hash")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("rare").alias("rare"))
    grouped = saved(groups, "groups")
    found = saved(signed.select("id", "text_hash", "node", "n_shingles"), "found")
    freed(signed)
    pairs = saved(_pairs(grouped, percent), "pairs")
    nodes, rare = saved(grouped.select("node", "least", "row"), "nodes"), saved(grouped.select("node", "n_shingles", "rare"), "rare")
    freed(grouped)
    sets = _members(narrow, nodes, pairs, k)
    links = saved(_confirmed(pairs, sets, percent), "links")
    early = components(links)
    # All that is left: sets of different components.
    apart = _apart(rare, early, percent)
    freed(pairs, sets, links, rare)
    sets = _members(narrow, nodes, apart, k)
    links = saved(_confirmed(apart, sets, percent), "links")
    freed(apart, sets)
    # These link components, named by one of their sets.
    one, two = (early.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(between)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("group"))
    alone = joined.join(early, "node", "left_anti").select("node", F.col("component").alias("group"))
    linked = saved(early.join(moved, "component", "left").select("node", F.coalesce("group", "component").alias("group")).unionByName(alone), "linked")
    named = saved(linked.join(nodes.select("node", "least"), "node").groupBy("group").agg(F.min("least").alias("component_id")), "named")
    of = saved(nodes.select("node", "least").join(linked, "node", "left").join(named, "group", "left").select("node", F.coalesce("group", "node").alias("group"), F.when(F.col("group").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "components")
    freed(links, early, joined, linked, named, nodes)
    out = found.join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), *(["text_hash", "group"] if keyed else []), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
