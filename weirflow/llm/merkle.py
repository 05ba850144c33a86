"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of sentences.

Blank lines part sections, line ends part paragraphs, and a paragraph is cut
after sentence ends and, at a space, within PIECE bytes; pieces are the leaves
and together are the whole text, separators included.  A leaf's hash is that of
its bytes, an inner node's that of its children's, so equal roots mean equal
texts.  The fingerprint spells the tree: the root's hash, then for each section
its code and, in brackets, for each paragraph its code and those of its leaves;
a code is CODE letters of a node's hash.

Two trees are compared from the root: children of equal hash pair off with all
that is below them, and only what is left is taken apart.  Likeness is the Dice
coefficient of the leaves below the branches that pair off.  ``differences``
locates edits in the same way, by place.

Defined cases: a null text is the empty text, which has no leaf; equal texts,
empty ones too, have likeness 1, an empty and another text 0; a table's last
document, in ascending order of key (nulls first) and text hash, is followed by
its first; a lone document follows itself; repeated rows are documents that
follow one another; keys may be of any type that sorts, null and repeated; a
very long text is one tree; other columns, whatever their names, have no effect;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import sliced, tune

PIECE = 64
#: Letters of six bits each.
CODE = 8
#: Cuts of the first level that a row is held against, before those between two of them.
STRIDE = 128
_LEAF = re.compile(rb"[^.!?]{1,%d}(?:[.!?]+\s*|(?<=\s)|$)|[^.!?]{1,%d}|[.!?]+\s*" % (PIECE - 1, PIECE))
_SECTION = re.compile(rb"\n[^\S\n]*\n\s*")
_PARAGRAPH = re.compile(rb"[^\n]*\n|[^\n]+$")
_hash = xxhash.xxh3_128_digest


class Node(NamedTuple):
    """A node's hash, its leaves, its span of bytes and its children."""

    hash: bytes
    leaves: int
    start: int
    end: int
    children: list

    @property
    def code(self) -> str:
        return b64encode(self.hash[: CODE * 6 // 8]).decode()


def _parent(children: list[Node], level: bytes, at: int) -> Node:
    return Node(_hash(level + b"".join([c.hash for c in children])), sum([c.leaves for c in children]), at, children[-1].end if children else at, children)


def tree(raw: bytes) -> Node:
    """Root over sections over paragraphs over pieces; each level covers all bytes."""
    sections, at = [], 0
    for cut in [*(m.end() for m in _SECTION.finditer(raw)), len(raw)]:
        if cut == at:
            continue
        paragraphs = []
        for line in _PARAGRAPH.finditer(raw, at, cut):
            begin, leaves = line.start(), []
            for piece in _LEAF.findall(line[0]):
                leaves.append(Node(_hash(piece), 1, begin, begin + len(piece), []))
                begin += len(piece)
            paragraphs.append(_parent(leaves, b"p", line.start()))
        sections.append(_parent(paragraphs, b"s", at))
        at = cut
    return _parent(sections, b"r", 0)


def spelled(root: Node) -> str:
    """The fingerprint of a tree."""
    codes = lambda nodes: "".join([n.code for n in nodes])
    return f"{root.hash.hex()}:" + "".join([f"{s.code}({','.join([p.code + codes(p.children) for p in s.children])})" for s in root.children])


def fingerprint(raw: bytes) -> str:
    return spelled(tree(raw))


def _shared(a: list[Node], b: list[Node]) -> int:
    """Leaves below the nodes that pair off."""
    if not a or not b:
        return 0
    there = Counter([n.hash for n in b])
    found, rest = 0, []
    for n in a:
        if there.get(n.hash, 0):
            there[n.hash] -= 1
            found += n.leaves
        else:
            rest.append(n)
    if not rest or not rest[0].children and not rest[-1].children:
        return found
    others = []
    for n in b:
        if there.get(n.hash, 0):
            there[n.hash] -= 1
            others.append(n)
    return found + _shared([c for n in rest for c in n.children], [c for n in others for c in n.children])


def likeness(a: Node, b: Node) -> float:
    if a.hash == b.hash:
        return 1.0
    return 2.0 * _shared(a.children, b.children) / (a.leaves + b.leaves)


def differences(a: Node, b: Node) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Spans of bytes in a and in b that differ, found by descending only where hashes differ."""
    if a.hash == b.hash:
        return []
    if not a.children or not b.children:
        return [((a.start, a.end), (b.start, b.end))]
    x, y = a.children, b.children
    head = 0
    while head < min(len(x), len(y)) and x[head].hash == y[head].hash:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].hash == y[-1 - tail].hash:
        tail += 1
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    both = min(len(x), len(y))
    found = [d for p, q in zip(x[:both], y[:both], strict=True) for d in differences(p, q)]
    if len(x) != len(y):  # the rest was put in or taken out here
        spans = []
        for n, rest in ((a, x[both:]), (b, y[both:])):
            here = n.children[head + both].start if head + both < len(n.children) else n.end
            spans.append((rest[0].start, rest[-1].end) if rest else (here, here))
        found.append((spans[0], spans[1]))
    return found


def _array(values: list, kind: T.DataType) -> Column:
    """A literal array; one node in the plan, however long."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>").cast(T.ArrayType(kind))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, ahead, k, x, text) in ascending order of key and text hash x within each part; a part's last row (ahead = 1) is the first of the next part.

    Parts are ranges of (k, x), as even as Spark's range partitions over those two columns, so a hot key is split by
    its texts.  There are as many as shuffle partitions, and only their first rows are looked up across parts.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(words).alias("x"), words.alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("k", "x").repartitionByRange(parts, F.col("k").asc_nulls_first(), "x")
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "x")).alias("first"))
    firsts = [(r["k"], r["known"], r["x"]) for r in least.select(F.col("first.k").cast("string").alias("k"), F.col("first.k").isNotNull().alias("known"), "first.x", "first").orderBy("first").collect()]
    if not firsts:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("ahead"), "k", "x", "text")
    kind = rows.schema["k"].dataType
    cuts = F.arrays_zip(_array([f[0] for f in firsts], kind).alias("k"), _array([str(f[2]) for f in firsts], T.LongType()).alias("x"))
    coarse = F.arrays_zip(_array([f[0] for f in firsts[::STRIDE]], kind).alias("k"), _array([str(f[2]) for f in firsts[::STRIDE]], T.LongType()).alias("x"))
    own = F.struct("k", "x")
    reached = lambda some: F.size(F.filter(some, lambda b: b <= own))
    placed = rows.withColumn("block", F.greatest(reached(coarse) - 1, F.lit(0)))
    placed = placed.withColumn("part", F.col("block") * STRIDE + reached(F.slice(cuts, F.col("block") * STRIDE + 1, F.lit(STRIDE))) - 1)
    rows = placed.select("part", F.lit(0).alias("ahead"), "k", "x", "text")
    after = spark.createDataFrame([((i - 1) % len(firsts), *f) for i, f in enumerate(firsts)], "before int, first string, known boolean, first_x long")
    after = F.broadcast(after.withColumn("first", F.col("first").cast(kind)))  # one row for each part
    heads = rows.join(after, F.col("k").eqNullSafe(F.col("first")) & (F.col("x") == F.col("first_x")))
    heads = heads.groupBy("before").agg(F.min(F.struct("k", "x", "text")).alias("t"))
    ahead = heads.select(F.col("before").alias("part"), F.lit(1).alias("ahead"), "t.k", "t.x", "t.text")
    return rows.unionByName(ahead).repartitionById(len(firsts), "part").sortWithinPartitions("part", "ahead", F.col("k").asc_nulls_first(), "x")


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", *, share: int = 4) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next text.

    Edited: the last n // ``share`` code points give way to the first as many (or all) of the next text.  ``edit_from``
    and ``edit_to`` are the bytes of the text that hold all differing branches (null if none differs).
    """
    tune(docs.sparkSession)
    rows = with_next(docs, key, text)
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
        T.StructField("edit_from", T.LongType()), T.StructField("edit_to", T.LongType()),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in sliced(batches):
            out: list[list] = [[] for _ in schema.names]
            for part, ahead, k, words in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                own = tree(words.encode())
                if held and held[0] == part:
                    _, k0, text0, tree0 = held
                    n, cut = len(text0), len(text0) // share
                    edited = (text0[: n - cut] + words[:cut]).encode()
                    changed = tree(edited)
                    spans = [a for a, _ in differences(tree0, changed)]
                    row = (k0, n, hashlib.sha256(edited).hexdigest(), spelled(tree0), spelled(changed), likeness(tree0, changed), likeness(tree0, own), min((a for a, _ in spans), default=None), max((b for _, b in spans), default=None))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                held = None if ahead else (part, k, words, own)
            kinds = (batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=schema.names)

    return rows.mapInArrow(apply, schema)
