"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes (each step doubles it and adds a random
number of the next byte, so in 32 bits it depends on the last 32 bytes only); a
chunk ends where the hash's top bits are zero, at a character boundary, and
after ``least`` bytes or more, ``most`` at the latest.  Ends follow the content,
so an insertion shifts no chunk beyond its surroundings.

Chunks are deduplicated by a 128-bit digest over the whole table: the first, in
the order of key, text hash and place, stays.  A later one goes if it lies in a
run of such chunks of ``run`` bytes or more, or if the run is the whole text.
By default ``run`` is ``least``: only the last chunk of a text can be shorter,
and alone it is a coincidence of a few words, unless the text has no other.

Counts are combined before the shuffle and only digests that occur twice join
the chunks, so a hot chunk is a matter of a join that Spark splits.

Defined cases: null and empty texts have no chunk; rows equal in key and text
are one document, and all lose the same; null keys come first, then ascending
ones, and among equal keys the order of the text hash; a very long text is cut
as any other, in linear time; other columns, whatever their names, have no
effect; an empty table gives no rows.
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

REACH = 32
#: Bytes hashed at once.
SEGMENT = 1 << 22
_GEAR = np.random.default_rng(20240612).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def boundaries(data: np.ndarray, bits: int) -> np.ndarray:
    """Places before which a chunk may end: the hash up to there has ``bits`` leading zeros, and a character begins."""
    out = []
    for a in range(0, len(data), SEGMENT):
        low = max(0, a - REACH + 1)
        h = _GEAR[data[low : a + SEGMENT]]
        reach = 1
        while reach < REACH:
            h[reach:] += h[:-reach] << np.uint32(reach)
            reach *= 2
        at = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + low + 1
        out.append(at[at > a])
    at = np.concatenate(out) if out else np.zeros(0, np.int64)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def chunk_ends(data: np.ndarray, start: int, end: int, at: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of data[start:end]; ``at``: ascending boundaries over all of ``data``."""
    out, here = [], start
    inner = at[np.searchsorted(at, start + least) : np.searchsorted(at, end)].tolist()
    i = 0
    while end - here > least:
        while i < len(inner) and inner[i] < here + least:
            i += 1
        stop = inner[i] if i < len(inner) else end
        if stop > here + most:
            stop = here + most
            while stop > here + least and data[stop] & 0xC0 == 0x80:
                stop -= 1
        here = min(stop, end)
        out.append(here)
    if here < end:
        out.append(end)
    return out


def chunk_rows(texts: DataFrame, *, bits: int = 5, least: int = 32, most: int = 512) -> DataFrame:
    """(k, x, place, size, c1, c2) of each chunk of texts (k, x, text); c1 and c2 are its digest."""
    schema = T.StructType([texts.schema["k"], T.StructField("x", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("place", "size")), *(T.StructField(n, T.LongType()) for n in ("c1", "c2"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(2))
            at = boundaries(data, bits)
            owner, place, size, digest = [], [], [], []
            raw = memoryview(data.tobytes())
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                stops = chunk_ends(data, a, b, at, least, most)
                begins = [a, *stops[:-1]]
                owner.append(np.full(len(stops), i))
                place.append(np.array(begins[: len(stops)], np.int64) - a)
                size.append(np.array(stops, np.int64) - np.array(begins[: len(stops)], np.int64))
                digest.extend([xxhash.xxh3_128_digest(raw[p:q]) for p, q in zip(begins, stops, strict=False)])
            owner = pa.array(np.concatenate(owner) if owner else np.zeros(0, np.int64))
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            numbers = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (place, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *map(pa.array, numbers), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=schema.names)

    return texts.select("k", "x", "text").mapInArrow(apply, schema)


def dedup_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", *, bits: int = 5, least: int = 32, most: int = 512, run: int | None = None) -> DataFrame:
    """key, n_bytes, n_chunks_again (chunks seen before), n_removed, spans (removed runs) and kept_text of each row."""
    tune(docs.sparkSession)
    run = least if run is None else run
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    chunks = chunk_rows(rows, bits=bits, least=least, most=most)
    often = chunks.groupBy("c1").count().where(F.col("count") > 1).select("c1")
    scratch = Scratch(docs.sparkSession)
    held = scratch.write(chunks.join(often, "c1"))
    order = F.struct(F.col("k"), F.col("x"), F.col("place"))
    # written, so that the join below reads plain exchanges, whose hot partitions Spark splits
    first = scratch.write(held.groupBy("c1", "c2").agg(F.min(order).alias("first")))
    again = held.join(first, ["c1", "c2"]).where(order > F.col("first"))
    per_row = again.select("k", "x", "place", "size").distinct().groupBy("k", "x").agg(F.collect_list(F.struct("place", "size")).alias("again"))
    per_row = per_row.select(F.col("k").alias("k2"), F.col("x").alias("x2"), "again")
    marked = rows.join(per_row, rows["k"].eqNullSafe(per_row["k2"]) & (rows["x"] == per_row["x2"]), "left").select("k", "text", "again")
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_chunks_again", "n_removed")), T.StructField("spans", span), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(1))
            spans, kept, counts = [], [], []
            for i, again in enumerate(batch.column(2).to_pylist()):
                raw = data[starts[i] : ends[i]].tobytes()
                runs: list[list[int]] = []
                for p, n in sorted((c["place"], c["size"]) for c in again or ()):
                    if runs and runs[-1][1] == p:
                        runs[-1][1] = p + n
                    else:
                        runs.append([p, p + n])
                runs = [r for r in runs if r[1] - r[0] >= run or r == [0, len(raw)]]
                edge = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                spans.append([{"from": a, "to": b} for a, b in runs])
                counts.append(len(again or ()))
            removed = [sum(s["to"] - s["from"] for s in x) for x in spans]
            pair = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return marked.mapInArrow(cut, schema)
