"""Benchmark decontamination by spaced-seed hashing.

Fixed masks keep four of up to eight neighbouring word positions and ignore the
rest.  Hashes of the kept words of every position of every text meet those of
the benchmark in a join; around each hit the two word sequences are aligned and
a run of ``window`` words (the whole item if it is shorter) that agrees in at
least ``share`` of its positions is an overlap, whatever words were substituted.
Items too short for the masks have a mask of their own length that ignores no
position, and match only if their whole word sequence stands in a text.

Before the join, positions are held against a bit table of the benchmark's
hashes, so those that can't match never leave the task that made them.  The
table has a fixed size and is the result of a scalar subquery, so plans don't
grow with it; a larger benchmark fills it and lets more positions through to
the join, which stays exact.

Places of items with the same words around them are one class: it is verified
once, whatever number of items shares it.  Only DataFrame functions run.

Words are maximal runs of letters and digits, lower-cased.  Defined cases: null,
empty and wordless texts and items match nothing; items of equal text are all
reported; of the best runs of a text and an item the first in the text is told;
a text is judged by itself, so equal texts agree whatever their keys, and rows
with equal keys and different texts are reported under the one key; very long
texts are taken whole; an empty table, of documents or items, gives no overlap;
other columns of either table, whatever their names, have no effect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import Scratch, free_name

#: Kept positions of each mask; any run of 8 to 15 words with up to one in five substituted keeps a hit of one of them.
MASKS = ((0, 1, 2, 5), (0, 1, 3, 6), (0, 2, 3, 7))
#: Runs that the masks serve, in words, and the least share of them that must agree.
MIN_WORDS, MAX_WORDS, MIN_SHARE = 8, 15, 0.8
#: Items too short for the masks: one mask for each length.
SHORT = tuple(tuple(range(n)) for n in range(1, MIN_WORDS))
#: The bit table has 2**TABLE_BITS bits.
TABLE_BITS = 22


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hash(ids: str, at: Column, mask: tuple[int, ...], number: int) -> Column:
    """The kept words' hash; ``number`` tells masks apart."""
    return F.xxhash64(F.lit(number), *(F.get(F.col(ids), at + o) for o in mask))


def _ids(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _word(h: Column, probe: int) -> Column:
    return F.shiftrightunsigned(h, 64 - (TABLE_BITS - 6) - 26 * probe).bitwiseAND(F.lit((1 << (TABLE_BITS - 6)) - 1)).cast("int")


def _bit(h: Column, probe: int) -> Column:
    return F.shiftrightunsigned(h, 6 * probe).bitwiseAND(F.lit(63)).cast("int")


def seeds_of(benchmark: DataFrame, item: str, text: str, window: int, share: float) -> DataFrame:
    """(mask, h, off, part, compared, need, items): classes of places at which a mask fits an item.

    ``part``: the words up to ``window`` - 1 to either side of the place, which is word ``off`` in it.
    """
    rows = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).where("size(words) > 0")
    n = F.size("words")
    rows = rows.withColumns({"ids": _ids("words"), "compared": F.least(F.lit(window), n), "need": F.when(n < MIN_WORDS, n).otherwise(F.ceil(F.least(F.lit(window), n) * share)).cast("int")})
    last = F.when(n < MIN_WORDS, 0).otherwise(n - 1)
    rows = rows.select("item", "words", "ids", "compared", "need", F.explode(F.sequence(F.lit(0), last)).alias("at"))

    def placed(number: int, mask: tuple[int, ...], fits: Column) -> Column:
        return F.when(fits, F.struct(F.lit(number).alias("mask"), _hash("ids", F.col("at"), mask, number).alias("h")))

    long = [placed(i, m, (n >= MIN_WORDS) & (F.col("at") + m[-1] < n)) for i, m in enumerate(MASKS)]
    short = [placed(len(MASKS) + i, m, n == len(m)) for i, m in enumerate(SHORT)]
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = [(F.col("at") - first).alias("off"), F.slice("words", first + 1, F.col("at") - first + window).alias("part")]
    each = rows.select("item", "compared", "need", *around, F.explode(F.array(*long, *short)).alias("s")).where("s is not null")
    return each.groupBy("s.mask", "s.h", "off", "part", "compared", "need").agg(F.collect_set("item").alias("items"))


def bit_table(seeds: DataFrame) -> DataFrame:
    """One row: the bits that the seeds set, as an array of 2**(TABLE_BITS - 6) longs, whatever the benchmark's size."""
    probes = F.array(*(F.struct(_word(F.col("h"), p).alias("word"), _bit(F.col("h"), p).alias("bit")) for p in (0, 1)))
    held = seeds.select(F.inline(probes)).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = seeds.sparkSession.range(1 << (TABLE_BITS - 6)).select(F.col("id").cast("int").alias("word")).join(held, "word", "left")
    filled = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(filled, lambda x: x["bits"]).alias("bits"))


def _hits(rows: DataFrame, text: str, keys: list[str], seeds: DataFrame, table: DataFrame, window: int) -> DataFrame:
    """Keys, class columns, doc_at, from and near: places of texts whose kept words are a class's."""
    k = [f"k{i}" for i in range(len(keys))]
    rows = rows.select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), words_of(F.col(text)).alias("w")).where("size(w) > 0").withColumn("ids", _ids("w"))
    bits, n, at, h = table.scalar(), F.size("ids"), F.col("doc_at"), F.col("h")
    lengths = [r["mask"] - len(MASKS) for r in seeds.select("mask").where(F.col("mask") >= len(MASKS)).distinct().collect()]  # as many as SHORT at most
    used = [*range(len(MASKS)), *(len(MASKS) + i for i in sorted(lengths))]
    masks = [*MASKS, *SHORT]
    hashes = F.array(*(F.when(at + masks[i][-1] < n, _hash("ids", at, masks[i], i)) for i in used))
    held = (F.getbit(F.get(bits, _word(h, p)), _bit(h, p)) == 1 for p in (0, 1))
    # one stage of generated code from the array of ids to the few places that are left; small enough for the JVM to compile
    places = rows.select(*k, "w", "ids", F.explode(F.sequence(F.lit(0), n - 1)).alias("doc_at")).select(*k, "w", "doc_at", F.posexplode(hashes).alias("mask", "h"))
    places = places.where(reduce(lambda x, y: x & y, held, h.isNotNull()))
    first = F.greatest(at - (window - 1), F.lit(0))
    mask = F.col("mask") if used == list(range(len(used))) else F.get(F.array(*map(F.lit, used)), F.col("mask"))
    near = places.select(*k, "doc_at", first.alias("from"), F.slice("w", first + 1, at - first + window).alias("near"), mask.alias("mask"), "h")
    return near.join(seeds, ["mask", "h"])


def _verified(hits: DataFrame, window: int, kept: list[str]) -> DataFrame:
    """Hits whose best run agrees in ``need`` words, with that run: matched and minus_at.

    Agreement of the words around a hit is a number's bits; runs are shifts of it, all in generated code.
    """
    reach = window - 1
    place, doc_at, off, compared = F.col("doc_at") - F.col("from"), F.col("doc_at"), F.col("off"), F.col("compared")
    same = (F.when(F.get("near", place + o) == F.get("part", off + o), 1 << (o + reach)).otherwise(0) for o in range(-reach, reach + 1))
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))  # noqa: E731  a value that the optimizer copies to no other place
    bits = once(hits, "bits", reduce(lambda x, y: x + y, same))
    inside = lambda s: (compared >= 1 - s) & (off + s >= 0) & (off + s + compared <= F.size("part"))
    count = lambda s: F.bit_count(F.shiftright("bits", s + reach).bitwiseAND(F.col("ones")))
    # the most matches, then the first place
    runs = (F.when(inside(s), count(s) * 64 - s).otherwise(-1) for s in range(-reach, 1))
    best = once(bits.withColumn("ones", F.expr("shiftleft(1, compared) - 1")), "best", F.greatest(*runs))
    told = best.withColumns({"matched": F.shiftright("best", 6), "minus_at": F.col("best").bitwiseAND(F.lit(63)) - doc_at})
    return told.where("best >= 0 and matched >= need").select(*kept, F.struct("matched", "minus_at").alias("best"))


def _checked(window: int, share: float) -> None:
    if not MIN_WORDS <= window <= MAX_WORDS or not MIN_SHARE <= share <= 1:
        raise ValueError(f"the masks serve windows of {MIN_WORDS} to {MAX_WORDS} words that agree in {MIN_SHARE} of them or more")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, share: float = 0.8) -> DataFrame:
    """One row for each text and item that overlap: keys, item, word_at (first word of the best run), matched, compared."""
    _checked(window, share)
    scratch = Scratch(docs.sparkSession)
    seeds = scratch.write(seeds_of(benchmark, item, item_text, window, share))
    k = [f"k{i}" for i in range(len(keys))]
    best = _verified(_hits(docs, text, keys, seeds, scratch.write(bit_table(seeds)), window), window, [*k, "items", "compared", "need"])
    each = best.select(*k, "compared", "best", F.explode("items").alias("item"))
    grouped = each.groupBy(*k, "item").agg(F.max(F.struct("best.matched", "best.minus_at", "compared")).alias("top"))
    return grouped.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), F.col("item").alias(item), (-F.col("top.minus_at")).alias("word_at"), F.col("top.matched").alias("matched"), F.col("top.compared").alias("compared"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, share: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; decided by text, so null and repeated keys don't matter."""
    _checked(window, share)
    scratch = Scratch(docs.sparkSession)
    seeds = scratch.write(seeds_of(benchmark, item, item_text, window, share))
    (digest,) = free_name(docs, "digest")
    marked = docs.withColumn(digest, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    found = _verified(_hits(marked, text, [key, digest], seeds, scratch.write(bit_table(seeds)), window), window, ["k0", "k1", "need"])
    # written, so that Spark knows its size when it chooses the join
    bad = scratch.write(found.select("k0", "k1").distinct())
    return marked.join(bad, marked[key].eqNullSafe(bad["k0"]) & (marked[digest] == bad["k1"]), "left_anti").select(*docs.columns)
