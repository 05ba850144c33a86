"""Near-duplicates by SimHash links, and by what they miss of the exact similarity of word shingles.

Two texts are near-duplicates if the Jaccard similarity of their sets of shingles (``words`` words, ASCII lower-cased,
split at ASCII white space) is ``least`` or more; chains of them form a component.

First links: SimHash fingerprints of the sets, joined by the trie self-join of ``simhash`` within its budget of
differing bits, and equal ones.  Each is held against the whole shingle sets, so no link is below ``least``.

What fingerprints miss: two sets of similarity 0.8 differ in 9.7 of 64 bits on average, and in more than 4 in 98 of 100
cases; a budget that loses one in a thousand would be 19 bits, within which one in a thousand of all pairs of unrelated
texts lies.  So the rest of the candidates comes from BANDS bands of ROWS MinHash values each: two texts that agree in a
band share a bucket.  A pair of similarity 0.8 shares none with probability (1 - 0.8**4)**20 = 0.00003, more similar ones
more rarely.  A parity sketch has a bit for each of PARITY values of a hash: whether an odd number of shingles have it.
Two sketches differ in as many bits as shingles are in one set only, or fewer; pairs that differ in more than ``least``
allows are no candidates.

Rounds: each bucket has a head, the node that meets the most others in its buckets, as the middle of a group of edited
copies does.  Every text is compared with the heads of its buckets, linked with the closest by the sketch, checked and
contracted.  A later round's head is the one of those that are in no earlier head's component.  Rounds go on as long as
buckets have many such texts and a round leaves notably fewer.  Then all pairs that share a bucket but not a component are
compared, each pair in one of its buckets.  So a large group costs a comparison or two a member, and beyond that those
pairs whose sketches allow ``least`` while no link to a head has joined them.

Hot groups: texts of one shingle set are one node; a task emits each set once.  Sets that no pair needs are left out
before any shuffle as long as the pairs' nodes are few enough to be broadcast, in the shuffle beyond that.

Defined cases: null, empty and blank texts have the empty set and are copies of one another; fewer words than a shingle
make one shingle of them all; a very long text is one set; repeated rows are copies; null and repeated keys join nothing
by themselves; other columns, whatever their names, have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import Scratch, among, free_name, sliced, tune, utf8
from weirflow.llm.simhash import contract, keep_least, trie_links

SEED = 42
BANDS = 20
ROWS = 4
PARITY = 1024
#: Shingles hashed by all functions at once.
SEGMENT = 1 << 12
_RANDOM = np.random.default_rng(20250117)
_XOR = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(raw: bytes, words: int = 5) -> np.ndarray:
    """Ascending distinct hashes of a UTF-8 text's shingles."""
    tokens = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    begin = np.cumsum(size + 1) - size - 1
    last = max(len(tokens) - words, 0) + 1
    starts, ends = begin[:last], (begin + size)[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, last))


def node(grams: np.ndarray) -> int:
    """The unsigned 64-bit name of a set."""
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def min_hashes(grams: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), SEGMENT):
        out = np.minimum(out, ((grams[i : i + SEGMENT] ^ _XOR) * _TIMES).min(axis=1))
    return out


def buckets_of(grams: np.ndarray) -> np.ndarray:
    """Each band's bucket."""
    bucket = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in min_hashes(grams).reshape(BANDS, ROWS).T:
        bucket = (bucket ^ row) * _TIMES[0, 0]
        bucket ^= bucket >> np.uint64(31)
    return bucket


def print_of(grams: np.ndarray) -> int:
    """The unsigned SimHash fingerprint of a set: bits that more than half of its shingles have."""
    held = np.zeros(64, np.int64)
    for i in range(0, len(grams), 1 << 16):
        held += np.unpackbits(grams[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * held > len(grams)).tobytes(), "big")


def parity(grams: np.ndarray) -> np.ndarray:
    """The parity sketch, as signed longs."""
    odd = np.bincount((grams % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


#: The set's size and its parity sketch.
SIG = T.StructType([T.StructField("n", T.IntegerType()), *(T.StructField(f"s{i}", T.LongType()) for i in range(PARITY // 64))])


def with_node(docs: DataFrame, text: str, *, words: int, name: str, keep: list[str], buckets: bool = False) -> DataFrame:
    """The columns ``keep`` and the text's node; with ``buckets`` also print (the fingerprint), sig and buckets."""
    tune(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*keep, text]))
    more = [T.StructField("print", T.LongType()), T.StructField("sig", SIG), T.StructField("buckets", T.ArrayType(T.LongType()))] if buckets else []
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField(name, T.LongType()), *more])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(batch.schema.get_field_index(text)))
            nodes, prints, sizes, sigs, places = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                grams = shingle_set(data[a:b].tobytes(), words)
                nodes.append(node(grams))
                if buckets:
                    prints.append(print_of(grams))
                    sizes.append(len(grams))
                    sigs.append(parity(grams))
                    places.append(buckets_of(grams))
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in keep), _signed(nodes)]
            if buckets:
                offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
                parts = np.concatenate(sigs).reshape(-1, PARITY // 64)
                sig = pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), *(pa.array(parts[:, i].copy()) for i in range(PARITY // 64))], names=SIG.names)
                columns += [_signed(prints), sig, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places).view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(apply, schema)


def sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(fp, grams): the shingle sets, each once in a task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            data, starts, ends = utf8(batch.column(0))
            nodes, held = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                grams = shingle_set(data[a:b].tobytes(), words)
                if (fp := node(grams)) not in seen:
                    seen.add(fp)
                    nodes.append(fp)
                    held.append(grams)
            offsets = pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
            grams = np.concatenate([np.zeros(0, np.uint64), *held])
            yield pa.RecordBatch.from_arrays([_signed(nodes), pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64)))], names=["fp", "grams"])

    return docs.select(text).mapInArrow(apply, "fp long, grams array<long>")


def _far() -> Column:
    """Bits in which the sketches sig and sig2 differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"sig.{n}").bitwiseXOR(F.col(f"sig2.{n}"))) for n in SIG.names[1:]))


def _close(least: float) -> Column:
    """False only if the sets of sig and sig2 are less similar than ``least``."""
    return _far() <= (F.col("sig.n") + F.col("sig2.n")) * ((1 - least) / (1 + least)) + 1e-6


def similar(pairs: DataFrame, grams: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b), which are written, whose sets have that similarity; only sets of a pair move."""
    own = among(grams, "fp", scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()))
    both = pairs.join(own.toDF("a", "grams_a"), "a").join(own.toDF("b", "grams_b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.where(shared + 1e-6 >= least * (F.size("grams_a") + F.size("grams_b") - shared)).select("a", "b")  # 0.8 * 35 > 28


def first_candidates(rows: DataFrame, scratch: Scratch, budget: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal, or linked by the trie self-join: one for each node or link."""
    own = scratch.write(rows.groupBy("print").agg(F.min("fp").alias("fp")))
    met = scratch.write(trie_links(own.select(F.col("print").alias("fp")), budget))
    apart = met.join(own.toDF("a", "fp_a"), "a").join(own.toDF("b", "fp_b"), "b").select("fp_a", "fp_b")
    equal = rows.select("print", "fp").distinct().join(own.toDF("print", "fp_b"), "print").where("fp <> fp_b").select("fp", "fp_b")
    return apart.union(equal).select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()


#: Rounds of heads go on while buckets have, by their texts, more than REST texts on average in no head's component, and
#: a round leaves this share fewer.
REST, GAIN = 16, 1 / 16


def heads(members: DataFrame, roots: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(bucket, n, rest, head) of buckets of several components: texts, those in the component of no head in ``tried``, and the most met of these."""
    seen = members.withColumn("seen", F.lit(None).cast("boolean"))
    if tried is not None:
        known = tried.join(roots, tried["fp"] == roots["node"], "left").select("bucket", F.coalesce("root", "fp").alias("root")).distinct()
        seen = members.join(known.withColumn("seen", F.lit(True)), ["bucket", "root"], "left")
    rest = F.col("seen").isNull()
    head = F.min(F.when(rest, F.struct((-F.col("met")).alias("met"), "fp", "sig", "root"))).alias("head")
    out = seen.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(rest).alias("rest"), head, F.min("root").alias("low"), F.max("root").alias("high"))
    return out.where("low <> high").select("bucket", "n", "rest", "head")


def open_pairs(members: DataFrame, mixed: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(a, b), each once: all pairs of a bucket in ``mixed`` but of two components whose sketches allow ``least``."""
    within = scratch.write(members.join(mixed.select("bucket"), "bucket").select("bucket", "fp", "sig", "root"))
    # two texts of two components have only buckets of several components in common: their least one makes the pair
    open_ = scratch.write(within.join(within.groupBy("fp").agg(F.collect_list("bucket").alias("own")), "fp"))
    scratch.drop(within)
    most = scratch.write(open_.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("m")).select("bucket", F.col("m.root").alias("most")))
    few = scratch.write(open_.join(most, "bucket").where(F.col("root") != F.col("most")).select("bucket", F.col("fp").alias("fp2"), F.col("sig").alias("sig2"), F.col("root").alias("root2"), "most", F.col("own").alias("own2")))
    other = (F.col("root") != F.col("root2")) & ((F.col("root") == F.col("most")) | (F.col("fp") < F.col("fp2")))
    once = F.array_min(F.array_intersect("own", "own2")) == F.col("bucket")
    return open_.join(few, "bucket").where(other & _close(least) & once).select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))


def links(docs: DataFrame, rows: DataFrame, text: str, scratch: Scratch, *, words: int, least: float, budget: int) -> DataFrame:
    """(node, root) of every node that has a link; ``rows``: fp, print, sig and buckets of each text."""
    first = scratch.write(first_candidates(rows, scratch, budget))
    places = rows.select("fp", F.explode("buckets").alias("bucket")).distinct()
    shared = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    own = places.join(shared, "bucket").groupBy("fp").agg(F.collect_list("bucket").alias("own"), F.sum("n").alias("met"))
    held = scratch.write(own.join(rows.select("fp", "sig").distinct(), "fp").select(F.explode("own").alias("bucket"), "fp", "sig", "met"))
    wanted = scratch.write(held.select("fp").union(first.select("a")).union(first.select("b")).distinct())
    grams = scratch.write(among(sets(docs, text, words), "fp", wanted).dropDuplicates(["fp"]))
    found = [scratch.write(similar(first, grams, least, scratch))]

    def rooted() -> tuple[DataFrame, DataFrame]:
        roots = scratch.write(contract(reduce(DataFrame.union, found), scratch))
        return roots, held.join(roots, held["fp"] == roots["node"], "left").select("bucket", "fp", "sig", "met", F.coalesce("root", "fp").alias("root"))

    roots, members = rooted()
    tried, before = None, 0
    while True:
        mixed = scratch.write(heads(members, roots, tried))
        work, texts = mixed.agg(F.sum(F.col("n") * F.col("rest")), F.sum("n")).first()
        if not work or tried is not None and (work <= REST * texts or work > before * (1 - GAIN)):
            break
        star = members.join(mixed.where("rest > 0").select("bucket", F.col("head.root").alias("root2"), F.col("head.fp").alias("fp2"), F.col("head.sig").alias("sig2")), "bucket")
        by = ["fp"] if tried is None else ["root", "root2"]
        best = star.where((F.col("root") != F.col("root2")) & _close(least)).groupBy(*by).agg(F.min(F.struct(_far().alias("far"), F.col("fp").alias("a"), F.col("fp2").alias("b"))).alias("best"))
        found.append(scratch.write(similar(scratch.write(best.select("best.a", "best.b")), grams, least, scratch)))
        new = mixed.where("rest > 0").select("bucket", F.col("head.fp").alias("fp"))
        tried, before = new if tried is None else tried.union(new), work
        roots, members = rooted()
    found.append(scratch.write(similar(scratch.write(open_pairs(members, mixed, least, scratch)), grams, least, scratch)))
    return rooted()[0]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, least: float = 0.8, budget: int = 4) -> DataFrame:
    """key, fp (the node of the row's shingle set) and root (one node of its component)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(with_node(docs, text, words=words, name="fp", keep=[key], buckets=True))
    roots = links(docs, rows, text, scratch, words=words, least=least, budget=budget)
    fps = rows.select(key, "fp")
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(key, "fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component, as keep_least chooses it."""
    (mark,) = free_name(docs, "fp")
    marked = with_node(docs, text, words=words, name=mark, keep=docs.columns)
    return keep_least(docs, marked, near_duplicates(docs, key, text, words=words, least=least), key, mark)
