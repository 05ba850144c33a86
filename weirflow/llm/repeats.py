"""Long exact repeats by the common-prefix interval tree of an enhanced suffix array.

Sampling: every window of ``report`` bytes picks the ``gram``-byte string in it
with the least hash (the last of equal ones), so equal windows pick the same
string at the same offset: an anchor.  Only anchors that occur at two places or
more can lie in a repeat, and only their surroundings move on: as far as the
middle window of a ``span``-byte string can see from its anchor.

Hot anchors: places with equal surroundings are one, known by a 128-bit digest;
they repeat in all of it, and a task passes on their bytes once.

Tree: the suffixes that begin at the different places of one anchor are sorted
(a sparse suffix array) with their common-prefix lengths; one stack scan gives
the tree of common-prefix intervals.  Within an interval the texts to the left,
read backwards, are sorted and scanned in the same way: each of their intervals
is left-diverse, since its members differ in the next byte to the left; those
that lie in one child of the right-hand interval are left to the child, where
they extend further right.  What remains are the maximal repeats, each with all
its occurrences.  An anchor with more than ``most`` different surroundings isn't
sorted in one task: its windows are hashed, and those that two surroundings
share are counted over all tasks, which gives the same bytes.

Equal texts are represented by one of them in all of this; a text that occurs
twice repeats in every byte.  Bytes in repeats of ``span`` are removed, those in
repeats of ``report`` only counted.

Defined cases: null texts are empty; texts under ``report`` bytes have no
repeat; repeated rows, keys equal or null, are different documents with equal
texts; very long texts are taken whole; other columns, whatever their names,
have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import Scratch, sliced, tune, utf8

#: Bytes hashed at once; positions within must fit in the low bits of a key.
SEGMENT = 1 << 21
PLACE_BITS = 24
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    reach, out = 1, key
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    more = width - reach
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the text and hash of every anchor.  Texts lie in ``data`` one after another."""
    owner, place, value = [], [], []
    long = np.flatnonzero(ends - starts >= span)
    if not len(long):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64)
    low, high = int(starts[long[0]]), int(ends[long[-1]])
    open_ = np.zeros(high - low + 1, np.int32)
    np.add.at(open_, starts[long] - low, 1)
    np.add.at(open_, ends[long] - span + 1 - low, -1)
    begins = np.cumsum(open_)[:-1] > 0  # a window of one text begins here
    size = min(SEGMENT, high - low) + span
    up, down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for a in range(low, high, SEGMENT):
        piece = data[a : min(a + SEGMENT + span - 1, high)]
        if len(piece) < span:
            break
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: len(piece) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        best = window_min(key, span - gram + 1)
        use = begins[a - low : a - low + len(best)]
        chosen = np.zeros(len(h), bool)
        chosen[(mask - (best[: len(use)][use] & mask)).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        owner.append(np.searchsorted(starts, at + a, side="right") - 1)
        place.append(at + a)
        value.append(h[at])
    owner, place, value = np.concatenate(owner), np.concatenate(place), np.concatenate(value)
    place, once = np.unique(place, return_index=True)  # windows of two segments may pick one place
    owner, value = owner[once], value[once]
    return owner, place - starts[owner], value


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the tree whose members share ``least`` or more; prefix[i] is between i-1 and i, prefix[0] unused."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefix) + 1):
        value, first = prefix[i] if i < len(prefix) else -1, i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            if length >= least:
                yield length, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _sorted(texts: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    order = sorted(members, key=texts.__getitem__)
    return order, [0, *(common(texts[x], texts[y]) for x, y in zip(order, order[1:], strict=False))]


def maximal_repeats(left: list[bytes], right: list[bytes], span: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of each maximal repeat of ``span`` bytes or more across an anchor.

    ``left`` (read backwards from the anchor) and ``right`` (from its first byte) hold different pairs.
    """
    order, prefix = _sorted(right, list(range(len(right))))
    widest = max(map(len, left))
    for r, first, last in intervals(prefix, max(0, span - widest)):
        child, at = {}, 0
        for p in range(first, last + 1):
            at += p > first and prefix[p] == r
            child[order[p]] = at
        by_left, left_prefix = _sorted(left, order[first : last + 1])
        for length, lo, hi in intervals(left_prefix, max(0, span - r)):
            members = by_left[lo : hi + 1]
            if any(child[m] != child[members[0]] for m in members):
                yield length, r, members


def _table(values: np.ndarray) -> list[np.ndarray]:
    """For each power of two the least of so many consecutive values."""
    out = [values]
    while 2 * (reach := 1 << (len(out) - 1)) <= len(values):
        out.append(np.minimum(out[-1][:-reach], out[-1][reach:]))
    return out


def tree_reach(left: list[bytes], right: list[bytes], spans: tuple[int, ...]) -> np.ndarray:
    """(span, place, 2): how far to the left and right of an anchor different surroundings repeat (0, 0: nowhere).

    One stack scan over the sorted suffixes gives the intervals, and for each of them the members' order by what is
    to their left, sorted once for all, gives the longest left extension that each member has in common with another:
    the maximal repeats that it is in.
    """
    order, prefix = _sorted(right, list(range(len(right))))
    by_left, left_prefix = _sorted(left, list(range(len(left))))
    rank = np.empty(len(left), np.int64)
    rank[by_left] = np.arange(len(left))
    rank = rank[order]
    least = _table(np.array(left_prefix))
    reach = np.zeros((len(spans), len(left), 2), np.int64)  # by rank
    for r, first, last in intervals(prefix, max(0, min(spans) - max(map(len, left)))):
        own = np.sort(rank[first : last + 1])
        low, high = own[:-1] + 1, own[1:] + 1
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        common_left = np.empty(len(low), np.int64)
        for k in np.unique(power):
            at = power == k
            common_left[at] = np.minimum(least[k][low[at]], least[k][high[at] - (1 << k)])
        longest = np.maximum(np.append(common_left, 0), np.append(0, common_left))
        for i, span in enumerate(spans):
            fits = longest + r >= span
            there = own[fits]
            reach[i, there, 0] = np.maximum(reach[i, there, 0], longest[fits])
            reach[i, there, 1] = np.maximum(reach[i, there, 1], r)
    out = np.empty_like(reach)
    out[:, by_left] = reach
    return out


#: Groups of as many places are scanned with arrays; smaller ones repeat by repeat.
ARRAYS = 12


def group_reach(left: list[bytes], right: list[bytes], spans: tuple[int, ...], again: list[bool] | None = None) -> list[tuple[tuple[int, int], ...]]:
    """For each span, how far to the left and right of the anchor each place repeats (0, 0: nowhere).

    Places with equal surroundings repeat in all of them; ``again``: those that have such a place elsewhere.
    """
    number: dict[tuple[bytes, bytes], int] = {}
    of = [number.setdefault(pair, len(number)) for pair in zip(left, right, strict=True)]
    reach = [[[0, 0] for _ in spans] for _ in number]
    if len(number) >= ARRAYS:
        reach = tree_reach([p[0] for p in number], [p[1] for p in number], spans).transpose(1, 0, 2).tolist()
    elif len(number) > 1:
        for l, r, members in maximal_repeats([p[0] for p in number], [p[1] for p in number], min(spans)):
            fits = [i for i, span in enumerate(spans) if l + r >= span]
            for m in members:
                for i in fits:
                    own = reach[m][i]
                    own[0], own[1] = max(own[0], l), max(own[1], r)
    seen = np.bincount(of, again if again is None else 1 + np.array(again), len(number)) if of else []
    for (x, y), i in number.items():
        if seen[i] > 1:
            for j, span in enumerate(spans):
                if len(x) + len(y) >= span:
                    reach[i][j] = [len(x), len(y)]
    return [tuple(map(tuple, reach[i])) for i in of]


def _anchor_rows(texts: DataFrame, gram: int, span: int) -> DataFrame:
    """(h, d, place) for texts (d, text)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(1))
            owner, place, value = anchors(data, starts, ends, gram, span)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(place)], names=["h", "d", "place"])

    return texts.select("d", "text").mapInArrow(apply, "h long, d binary, place long")


def _surroundings(texts: DataFrame, before: int, after: int) -> DataFrame:
    """(h, g, d, place, nth, left, right) for texts (d, text, found: array of h and place).

    g1 and g2 are the digest of left (read backwards from the anchor) and right (from its first byte), nth the number
    of their place in the task: 0 has the bytes, 1 tells that there are two, 2 stands for all further ones.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
    names = ["h", "g1", "g2", "d", "place", "nth", "left", "right"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in sliced(batches):
            out: list[list] = [[] for _ in names]
            found = batch.column(2).to_pylist()
            texts = batch.column(0).to_pylist()
            data, starts, ends = utf8(batch.column(1))
            for i, name in enumerate(texts):
                raw = data[starts[i] : ends[i]].tobytes()
                for f in found[i]:
                    p = f["place"]
                    low = max(0, p - before)
                    digest = xxhash.xxh3_128_digest(raw[low : p + after], seed=p - low)
                    own = f["h"].to_bytes(8, "big", signed=True) + digest
                    nth = seen.get(own, 0)
                    if nth < 2:
                        seen[own] = nth + 1
                    two = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                    row = (f["h"], *two, name, p, nth, raw[low:p][::-1] if nth == 0 else None, raw[p : p + after] if nth == 0 else None)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return texts.select("d", "text", "found").mapInArrow(apply, "h long, g1 long, g2 long, d binary, place long, nth byte, left binary, right binary")


_REACH = ("l1", "r1", "l2", "r2")


def _by_tree(kept: DataFrame, spans: tuple[int, int]) -> DataFrame:
    """(h, g1, g2, l1, r1, l2, r2) of repeated surroundings, from rows of one anchor after another, for each digest those with bytes first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, list] = {}
        anchor = None

        def close(out: list) -> None:
            if len(group) > 1 or any(x[2] for x in group.values()):
                reached = group_reach([x[0] for x in group.values()], [x[1] for x in group.values()], spans, [x[2] for x in group.values()])
                out.extend((anchor, *g, *(n for pair in each for n in pair)) for g, each in zip(group, reached, strict=True) if each[-1][1])

        def rows(out: list) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * 7
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], names=["h", "g1", "g2", *_REACH])

        for batch in batches:
            out: list = []
            for h, g1, g2, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != anchor:
                    close(out)
                    group.clear()
                    anchor = h
                if (g1, g2) in group:
                    group[g1, g2][2] = True
                else:
                    group[g1, g2] = [left, right, False]
            yield rows(out)
        out = []
        close(out)
        yield rows(out)

    return kept.select("h", "g1", "g2", "left", "right").mapInArrow(apply, "h long, g1 long, g2 long, l1 long, r1 long, l2 long, r2 long")


def _by_windows(kept: DataFrame, spans: tuple[int, int]) -> DataFrame:
    """The same for anchors of many surroundings: every window across the anchor is hashed and counted."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int8(), pa.int16(), pa.int64(), pa.int64())
        names = ["h", "g1", "g2", "many", "s", "l", "w1", "w2"]
        for batch in batches:
            for h, g1, g2, many, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = memoryview(left[::-1] + right)
                n = len(left)
                at = [(s, l) for s, span in enumerate(spans) for l in range(max(0, span - len(right)), min(n, span - 1) + 1)]
                two = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[n - l : n - l + spans[s]]) for s, l in at]), np.int64).reshape(-1, 2)
                size = len(at)
                columns = ([h] * size, [g1] * size, [g2] * size, [many] * size, [s for s, _ in at], [l for _, l in at], two[:, 0].copy(), two[:, 1].copy())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    windows = kept.select("h", "g1", "g2", "many", "left", "right").mapInArrow(apply, "h long, g1 long, g2 long, many boolean, s byte, l short, w1 long, w2 long")
    window = ["h", "s", "l", "w1", "w2"]
    own = F.struct("g1", "g2")
    shared = windows.groupBy(*window).agg(F.min(own).alias("low"), F.max(own).alias("high"), F.max("many").alias("many")).where("many or low < high").select(*window)
    met = windows.join(shared, window).groupBy("h", "g1", "g2")
    of = lambda s, x: F.coalesce(F.max(F.when(F.col("s") == s, x)), F.lit(0)).cast("long")
    return met.agg(*(c.alias(n) for n, c in zip(_REACH, (x for s, span in enumerate(spans) for x in (of(s, F.col("l")), of(s, span - F.col("l")))), strict=True)))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open spans, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _on_row(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Texts (k, d, text) with facts of (k2, d2): by key as well as digest, so copies of one text spread; used twice, shuffled once."""
    return rows.join(facts, rows["k"].eqNullSafe(facts["k2"]) & (rows["d"] == facts["d2"])).drop("k2", "d2")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, span: int = 400, report: int = 256, gram: int = 64, most: int = 100_000) -> DataFrame:
    """key, n_bytes, n_removed, spans (maximal removed runs), kept (remaining bytes), n_repeated (bytes in repeats of ``report``) of each row.

    Removed is each byte covered by a ``span``-byte string that also starts anywhere else in the table.
    """
    tune(docs.sparkSession)
    if not gram <= report <= span:
        raise ValueError("an anchor lies in a reported repeat, and that in a removed one")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.unhex(F.md5(F.col("text").cast("binary"))))
    long = F.octet_length("text") >= report
    found = scratch.write(_anchor_rows(rows.where(long), gram, report))
    # places are told apart by a 64-bit hash here, so that counts combine before the shuffle
    place = F.xxhash64("d", "place")
    # written, so that the join below reads plain exchanges, whose hot partitions Spark splits
    often = scratch.write(found.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("h"))
    again = found.join(often, "h").groupBy("d").agg(F.collect_set(F.struct("h", "place")).alias("found"))
    copies = rows.where(long).groupBy("d").agg(F.count("*").alias("copies"), F.min("k").alias("k"))
    chosen = again.join(copies, "d").select(F.col("k").alias("k2"), F.col("d").alias("d2"), "found")
    first = _on_row(rows, chosen).select("d", "text", "found")
    aside = (span - report) // 2  # from the ends of a removed string to its middle window
    places = scratch.write(_surroundings(first, aside + report - gram, span - aside))
    scratch.drop(found)
    reach = _reached(places.where("nth < 2"), (span, report), most, scratch)
    met = places.join(reach, ["h", "g1", "g2"]).select("d", *(F.struct((F.col("place") - F.col(f"l{i}")).alias("from"), (F.col("place") + F.col(f"r{i}")).alias("to")).alias(f"s{i}") for i in (1, 2)))
    spans = met.groupBy("d").agg(*(F.collect_set(F.when(F.col(f"s{i}.from") < F.col(f"s{i}.to"), F.col(f"s{i}"))).alias(f"s{i}") for i in (1, 2)))
    known = copies.join(spans, "d", "left").select("d", (F.col("copies") > 1).alias("whole"), "s1", "s2").where("whole or s2 is not null")
    per_row = rows.select("k", "d").distinct().join(known, "d", "left").select(F.col("k").alias("k2"), F.col("d").alias("d2"), "whole", "s1", "s2")
    marked = _on_row(rows, per_row)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))), T.StructField("kept", T.BinaryType()), T.StructField("n_repeated", T.LongType())])
    pair = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(1))
            all_spans, kept, removed, repeated = [], [], [], []
            for i, (whole, *held) in enumerate(zip(*(batch.column(j).to_pylist() for j in (2, 3, 4)), strict=True)):
                raw = data[starts[i] : ends[i]].tobytes()
                runs, told = ([(0, len(raw))] if whole and len(raw) >= least else merge_spans([(x["from"], x["to"]) for x in s or ()]) for s, least in zip(held, (span, report), strict=True))
                edge = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                removed.append(sum(b - a for a, b in runs))
                repeated.append(sum(b - a for a, b in told))
                all_spans.append([{"from": a, "to": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts), pa.array(removed, pa.int64()), pa.array(all_spans, pair), pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())], names=schema.names)

    return marked.select("k", "text", "whole", "s1", "s2").mapInArrow(cut, schema)


def _reached(kept: DataFrame, spans: tuple[int, int], most: int, scratch: Scratch) -> DataFrame:
    """(h, g1, g2, l1, r1, l2, r2) of repeated surroundings, from rows of _surroundings that have bytes, or are second in their task."""
    big = scratch.write(kept.where("nth = 0").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h"))
    none = big.isEmpty()
    tree = _by_tree((kept if none else kept.join(big, "h", "left_anti")).repartition("h").sortWithinPartitions("h", "g1", "g2", "nth"), spans)
    if none:
        return tree
    once = kept.join(big, "h").groupBy("h", "g1", "g2").agg((F.count("*") > 1).alias("many"), F.max("left").alias("left"), F.max("right").alias("right"))
    return tree.unionByName(_by_windows(once, spans))
