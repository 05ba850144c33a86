"""SimHash near-duplicates by a binary trie self-join.

Fingerprint: word shingles of the lower-cased text vote on 64 bits.

Join: the bits are cut into blocks, more than the ``budget`` of differing bits,
so two fingerprints within it agree on all blocks but ``budget`` of them; every
distinct fingerprint goes to one bucket for each choice of that many others, and
each bucket's binary trie over the other bits is joined with itself: pairs of
nodes are traversed together, differing bits accumulate along the way, and a
pair is pruned once they exceed the budget.  The more fingerprints there are,
the more blocks are cut, so that buckets stay of a size.  Passes of rising
budget let the last one also prune pairs of subtrees that lie in one component
already, so a dense cluster isn't expanded into all its pairs.  A bucket gives a
star of links per component; stars are merged across buckets by contraction in
rounds, each with an order of nodes of its own, which halve even a chain.

Hot groups: equal texts, and all rows of one fingerprint, collapse to one row
before the join; a bucket of more than ``slice_size`` fingerprints is cut into
slices whose pairs are separate tasks.

Defined cases: null, empty and blank texts have no words and fingerprint zero,
which links like any other; fewer words than a shingle make one shingle of
them all; a very long text is one document as any other; null keys are ignored
for the smallest key unless a component has no other; repeated rows and rows of
one key stay, each with the component of its text; other columns, whatever their
names, have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import Scratch, free_name, sliced, tune, utf8

BITS = 64
SEED = 42
#: Node pairs held at once, and the size of a pair of nodes whose leaves are compared directly.
FRONT = 1 << 20
LEAVES = 8
#: Rows of buckets that are joined at once.
BLOCK_ROWS = 200_000
#: Links to a file, and so to a task, when they are merged.
ROUND_ROWS = 1_000_000


def fingerprint(raw: bytes, words: int = 4) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    tokens = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    begin = np.cumsum(size + 1) - size - 1
    last = max(len(tokens) - words, 0) + 1
    starts, ends = begin[:last], (begin + size)[min(words, len(tokens)) - 1 :]
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, last, 1 << 16):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, BITS)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > last).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", *, words: int = 4, name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) and the fingerprint as a signed long."""
    tune(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != name.lower()] if keep is None else keep
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField(name, T.LongType(), False)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(batch.schema.get_field_index(text)))
            prints = np.array([fingerprint(data[a:b].tobytes(), words) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(prints.view(np.int64))], names=[*keep, name])

    return source.mapInArrow(apply, schema)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (each the least member's index) after links a-b are added to those of ``label``."""
    label = label.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


class TrieJoin:
    """Joins the tries of many buckets with themselves.

    ``keys``: the bits below the bucket's, moved to the top, ascending within each bucket; ``starts``: where buckets begin.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, depth: int, budget: int) -> None:
        self.keys, self.depth, self.budget = keys, depth, budget
        self.starts, self.ends = starts, np.append(starts[1:], len(keys))
        self.label = np.arange(len(keys))
        self.ones: dict[int, np.ndarray] = {}

    def components(self) -> np.ndarray:
        for budget in sorted({min(1, self.budget), min(2, self.budget), self.budget}):
            self.limit = budget
            self.change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.keys) else np.zeros(0, np.int64)
            self.links: list[tuple[np.ndarray, np.ndarray]] = []
            empty = np.zeros(0, np.int64)
            self.walk(0, self.starts, self.ends, empty, empty, empty, empty, empty)
            self.flush()
        return self.label

    def flush(self) -> None:
        if self.links:
            self.label = merged(self.label, np.concatenate([x for x, _ in self.links]), np.concatenate([y for _, y in self.links]))
            self.links = []

    def split(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the branch of bit 1 begins in each node."""
        if depth not in self.ones:
            bit = (self.keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int32), dtype=np.int32)])
        return high - (self.ones[depth][high] - self.ones[depth][low])

    def one_component(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.change[high - 1] == self.change[low]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(self.keys[a] ^ self.keys[b]) <= self.limit
        self.links.append((a[near], b[near]))

    def walk(self, depth: int, low: np.ndarray, high: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, spent: np.ndarray) -> None:
        """Nodes low..high with themselves, and pairs of nodes a..a_end and b..b_end that differ in ``spent`` bits so far."""
        while True:
            low, high = low[live := high - low > 1], high[live]
            low, high = low[live := ~self.one_component(low, high)], high[live]
            if len(a):
                joined = self.one_component(a, a_end) & self.one_component(b, b_end) & (self.label[a] == self.label[b])
                size = (a_end - a) * (b_end - b)
                few = (size <= LEAVES) & ~joined
                if few.any():
                    count = size[few]
                    owner = np.repeat(np.flatnonzero(few), count)
                    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                    width = (b_end - b)[owner]
                    self.link(a[owner] + at // width, b[owner] + at % width)
                live = ~joined & ~few
                a, a_end, b, b_end, spent = a[live], a_end[live], b[live], b_end[live], spent[live]
            if depth == self.depth or not len(low) and not len(a):
                if len(a):  # as many bits are equal as there are
                    self.links.append((a, b))
                return
            if len(a) > FRONT:
                empty = np.zeros(0, np.int64)
                for i in range(0, len(a), FRONT):
                    j = slice(i, i + FRONT)
                    self.walk(depth, empty, empty, a[j], a_end[j], b[j], b_end[j], spent[j])
                    if sum(len(x) for x, _ in self.links) > FRONT:
                        self.links = [self.distinct()]
                a = a_end = b = b_end = spent = empty
                continue
            mid, a_mid, b_mid = self.split(depth, low, high), self.split(depth, a, a_end), self.split(depth, b, b_end)
            both = (mid > low) & (mid < high)
            pairs = [
                (a, a_mid, b, b_mid, spent),
                (a_mid, a_end, b_mid, b_end, spent),
                (a, a_mid, b_mid, b_end, spent + 1),
                (a_mid, a_end, b, b_mid, spent + 1),
                (low[both], mid[both], mid[both], high[both], np.ones(both.sum(), np.int64)),
            ]
            kept = [tuple(x[(p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= self.limit)] for x in p) for p in pairs]
            a, a_end, b, b_end, spent = (np.concatenate(x) for x in zip(*kept, strict=True))
            low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
            depth += 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """As few links as join the same components as those so far."""
        a, b = np.concatenate([x for x, _ in self.links]), np.concatenate([y for _, y in self.links])
        label = merged(self.label, a, b)
        moved = np.flatnonzero(label != self.label)
        return moved, label[moved]


#: Fingerprints a bucket of random ones has at most, before more blocks are cut, and blocks at most.
BUCKET, MOST_BLOCKS = 256, 8


def _blocks(n: int) -> list[tuple[int, int]]:
    """Offset from the top and width of n blocks of bits."""
    edge = [BITS * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(edge, edge[1:], strict=False)]


def blocks_for(count: int, budget: int) -> int:
    """As few blocks as keep the buckets of so many fingerprints small."""
    n = budget + 1
    while n < MOST_BLOCKS and count > BUCKET << (BITS * (n - budget) // n):
        n += 1
    return n


def _places(blocks: int, budget: int) -> tuple[str, int]:
    """SQL for the block choice, bucket and other bits (moved to the top) of fp for each choice; and how many other bits there are at most."""
    cut = _blocks(blocks)
    out, depth = [], 0
    for number, chosen in enumerate(combinations(range(blocks), blocks - budget)):

        def packed(which: list[int]) -> tuple[str, int]:
            terms, size = [], 0
            for i in reversed(which):
                offset, width = cut[i]
                terms.append(f"shiftleft(shiftrightunsigned(fp, {BITS - offset - width}) & {(1 << width) - 1}L, {size})")
                size += width
            return " | ".join(terms), size

        bucket, _ = packed(list(chosen))
        rest, size = packed([i for i in range(blocks) if i not in chosen])
        depth = max(depth, size)
        out.append(f"struct({number} as block, {bucket} as bucket, shiftleft({rest}, {BITS - size}) as rest)")
    return ", ".join(out), depth


def trie_links(prints: DataFrame, budget: int = 4, *, slice_size: int = 50_000, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join what the budget joins; b is the least of a's component in a bucket."""
    places, depth = _places(blocks or blocks_for(prints.count(), budget), budget)
    rows = prints.select("fp").distinct().select("fp", F.inline(F.expr(f"array({places})")))
    big = rows.groupBy("block", "bucket").count().where(F.col("count") > slice_size).select("block", "bucket", F.ceil(F.col("count") / slice_size).cast("int").alias("slices"))
    cut = rows.join(big, ["block", "bucket"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: i != F.col("mine"))
    tasks = F.when(F.col("slices").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(others, lambda i: F.struct(F.least(i, F.col("mine")).alias("x"), F.greatest(i, F.col("mine")).alias("y"))))
    dealt = cut.withColumn("mine", mine).select("block", "bucket", "rest", "fp", F.inline(tasks))
    key = ["block", "bucket", "x", "y"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key).select(*key, "rest", "fp")

    def join(group: list[np.ndarray]) -> pa.RecordBatch:
        block, bucket, x, y, rest, fp = group
        rest = rest.view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = (np.diff(block) != 0) | (np.diff(bucket) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)
        owner = np.cumsum(new) - 1
        order = np.lexsort((rest, owner))
        fp = fp[order]
        label = TrieJoin(rest[order], np.flatnonzero(new), depth, budget).components()
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                group = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = np.flatnonzero((np.diff(group[0]) != 0) | (np.diff(group[1]) != 0) | (np.diff(group[2]) != 0) | (np.diff(group[3]) != 0))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield join([c[:cut] for c in group])
                held = [[c[cut:] for c in group]]
        if held and len(held[0][0]) + sum(len(h[0]) for h in held[1:]):
            yield join([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(apply, "a long, b long")


def contract(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every linked node; the root is one node of its component.

    Each round orders the nodes by a hash of its own, points each at the first of itself and its neighbours, and
    contracts the links along the pointers; the ends of half a chain's nodes fall together, so rounds grow with the
    logarithm of a component's size.  Every round's tables are written, and the pointers composed at the end.  Links
    only get fewer, so their first number bounds the files of every table.
    """
    files = max(1, -(-links.count() // ROUND_ROWS))
    edges = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().coalesce(files))
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c, step=len(pointers): F.struct(F.xxhash64(c, F.lit(step)).alias("rank"), F.col(c).alias("up"))
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("l")).select("l.*")
        up = scratch.write(both.groupBy("node").agg(F.min(ranked("other")).alias("first")).select("node", F.least("first", ranked("node"))["up"].alias("up")).coalesce(files))
        pointers.append(up)
        at_a = edges.join(up.toDF("a", "up_a"), "a").select("b", "up_a")
        moved = at_a.join(up.toDF("b", "up_b"), "b").where("up_a <> up_b")
        next_edges = scratch.write(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct().coalesce(files))
        scratch.drop(edges)
        edges = next_edges
    roots = None
    for up in reversed(pointers):
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            later = roots.toDF("up", "root")
            roots = up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classes(docs: DataFrame, key: str, text: str, words: int, budget: int) -> DataFrame:
    """key, fp, component and root: a fingerprint of the component, which tells apart those of one least key."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(with_fingerprint(docs, text, words=words, keep=[key]))
    roots = contract(scratch.write(trie_links(prints, budget)), scratch)
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(component, "root").select("fp", "component", "root")
    return prints.join(classes, "fp").select(key, "fp", "component", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 4, budget: int = 4) -> DataFrame:
    """key, fp (signed long) and component: the least key that a chain of links reaches, its own included."""
    return _classes(docs, key, text, words, budget).select(key, "fp", "component")


def keep_least(docs: DataFrame, marked: DataFrame, classes: DataFrame, key: str, mark: str) -> DataFrame:
    """One row of each root of ``classes`` (key, fp, root): one of the least key that isn't null, then of the least fp.

    ``marked``: ``docs`` with the fp in the column ``mark``.
    """
    least = classes.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("fp").alias("own"))).alias("least"))
    own, k = free_name(marked, "fp_kept", "key_kept")
    chosen = least.select(F.col("least.k").alias(k), F.col("least.own").alias(own))
    kept = marked.join(chosen, marked[key].eqNullSafe(chosen[k]) & (marked[mark] == chosen[own]))
    return kept.dropDuplicates([key, mark]).select(*docs.columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` with one row of each component, as keep_least chooses it; null and repeated keys don't merge components."""
    (mark,) = free_name(docs, "fp")
    return keep_least(docs, with_fingerprint(docs, text, words=words, name=mark), _classes(docs, key, text, words, budget), key, mark)
