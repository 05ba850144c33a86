"""Edit-aware token counts.

A text is cut into pre-tokens by the tokenizer's pattern; a token never crosses
a pre-token, so a text's count is the sum of theirs.  Blocks of pre-tokens are
the leaves of a segment tree that holds characters and tokens of every subtree.
``build_trees`` makes a table of trees, one a document, to be kept;
``apply_edits`` joins a table of edits with it and gives the table of the trees
after them.

An edit finds its blocks from the root, cuts the text anew from a pre-token that
ends LOOKAHEAD characters or more before the edit until a cut falls on an old
cut behind it (from there on all cuts are as before), and updates the sums on
the paths to the root.  Of a kept tree only blocks that an edit touches, and
their neighbours where its context reaches so far, are cut and encoded again.

Defined cases: null texts are empty and have no token; edit positions are held
to the text's ends; texts that spell special tokens are ordinary text; very long
texts are one tree, rebuilt when blocks have grown fourfold; rows of equal keys,
null too, are different documents that all get the edits of their key, and
repeated rows stay; edits of one document come in ascending ``seq`` (ties: by
start, stop, new), those of an unknown key, and null positions or texts, change
nothing; other columns are not kept, whatever their names; an empty table gives
no rows, an empty table of edits leaves all trees.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import Scratch, sliced, tune

#: The public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No pre-token depends on more characters behind its end.
LOOKAHEAD = 4
BLOCK = 32
CACHE = 500_000
_CUT = regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _encoder(ranks: bytes) -> Callable[[str], int]:
    """Tokens of a pre-token, remembered for the CACHE latest distinct ones."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            if len(known) >= CACHE:
                known.clear()
            n = known[piece] = len(encoding.encode_ordinary(piece))
        return n

    return count


class TokenTree:
    """A text with the counts of its pre-tokens under edits; ``encoded`` counts the pre-tokens encoded so far.

    A block is a list of pre-tokens and their counts, or, in a tree that was kept, its text until an edit touches it.
    """

    def __init__(self, text: str, count: Callable[[str], int]) -> None:
        self.count, self.encoded = count, 0
        self._build(self._cut(text))

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]) -> TokenTree:
        """The tree of a text whose sums were kept; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.encoded, tree.chars, tree.tokens = count, 0, list(chars), list(tokens)
        tree.width = len(chars) // 2
        ends = list(accumulate(chars[tree.width :]))
        tree.blocks = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return tree

    def _pieces(self, i: int) -> list[tuple[str, int]]:
        if isinstance(self.blocks[i], str):
            self.blocks[i] = self._cut(self.blocks[i])
        return self.blocks[i]

    def _words(self, i: int) -> str:
        return self.blocks[i] if isinstance(self.blocks[i], str) else "".join([p for p, _ in self.blocks[i]])

    def _cut(self, text: str) -> list[tuple[str, int]]:
        pieces = _CUT.findall(text)
        self.encoded += len(pieces)
        return [(p, self.count(p)) for p in pieces]

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        self.blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, block in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(len(p) for p, _ in block), sum(n for _, n in block)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(map(self._words, range(len(self.blocks))))

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one for the end), and where it begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at - begin >= self.chars[i] and begin + self.chars[i] < self.chars[1]:
                begin += self.chars[i]
                i += 1
        return min(i - self.width, len(self.blocks) - 1), begin

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts ``new`` in the place of characters start to stop."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        first, begin = self._find(max(0, start - LOOKAHEAD))
        keep = 0
        head = self._pieces(first)
        while keep < len(head) and begin + len(head[keep][0]) <= start - LOOKAHEAD:
            begin += len(head[keep][0])
            keep += 1
        last, last_begin = self._find(stop)
        old_begin = last_begin
        tail = last
        shift = len(new) - (stop - start)
        # the old text from ``begin`` on, as far as block ``tail``
        old = "".join([p for p, _ in head[keep:]]) + "".join(map(self._words, range(first + 1, last + 1)))
        cuts = {}  # old places where a pre-token begins, behind the edit -> (block, number in it)
        at = old_begin
        for i, (p, _) in enumerate(self._pieces(last)):
            if at >= stop:
                cuts[at] = (last, i)
            at += len(p)
        step = 1
        while True:
            region = old[: start - begin] + new + old[stop - begin :]
            whole = tail == len(self.blocks) - 1
            pieces, place, meet = [], begin, None
            for m in _CUT.finditer(region):
                if place - shift in cuts and place >= start + len(new):
                    meet = cuts[place - shift]
                    break
                if not whole and m.end() + LOOKAHEAD > len(region):
                    break
                pieces.append(m[0])
                place += len(m[0])
            else:
                if whole:
                    meet = (len(self.blocks), 0)
            if meet:
                break
            for _ in range(step):
                if tail < len(self.blocks) - 1:
                    tail += 1
                    for i, (p, _) in enumerate(self._pieces(tail)):
                        cuts[at] = (tail, i)
                        at += len(p)
                    old += self._words(tail)
            step *= 2
        self.encoded += len(pieces)
        fresh = [(p, self.count(p)) for p in pieces]
        end_block, end_piece = meet
        joined = head[:keep] + fresh
        if end_block < len(self.blocks):
            joined += self._pieces(end_block)[end_piece:]
        until = min(end_block, len(self.blocks) - 1)
        self._replace(first, until, joined)

    def _replace(self, first: int, last: int, pieces: list[tuple[str, int]]) -> None:
        """Deals the pieces to the blocks first to last, or builds the tree anew when they have grown fourfold."""
        n = last - first + 1
        size = -(-len(pieces) // n)
        if size > 4 * BLOCK:
            self._build([p for b in range(first) for p in self._pieces(b)] + pieces + [p for b in range(last + 1, len(self.blocks)) for p in self._pieces(b)])
            return
        touched = set()
        for i in range(n):
            block = self.blocks[first + i] = pieces[i * size : (i + 1) * size]
            leaf = self.width + first + i
            self.chars[leaf], self.tokens[leaf] = sum(len(p) for p, _ in block), sum(t for _, t in block)
            touched.add(leaf // 2)
        while touched - {0}:
            for i in touched - {0}:
                self._sum(i)
            touched = {i // 2 for i in touched - {0}}


EDIT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("new", T.StringType())])
_LONGS = T.ArrayType(T.LongType())


def sample_edits(text: str = "text") -> Column:
    """Three edits, each on the text that the one before leaves: an insertion, a deletion, an addition of the beginning at the end."""
    n = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    third = lambda i: F.floor(n * i / 3).cast("long")
    rows = [(third(1), third(1), F.lit(" [revised] ")), (third(2), third(2) + 20, F.lit("")), (n + 11, n + 11, F.substring(F.coalesce(F.col(text), F.lit("")), 1, 50))]
    return F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), a.alias("start"), b.alias("stop"), new.alias("new")) for i, (a, b, new) in enumerate(rows)))


def _ranks(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def build_trees(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, chars and tokens (a segment tree's sums, the root's at 1, leaves in the second half), n_pretokens of each row.

    ``vocabulary`` is the path of a file of ranks on the driver; it goes to executors with the tasks.
    """
    tune(docs.sparkSession)
    ranks = _ranks(docs, vocabulary)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("chars", _LONGS), T.StructField("tokens", _LONGS), T.StructField("n_pretokens", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(ranks.value)
        for batch in sliced(batches):
            trees = [TokenTree(words.as_py() or "", count) for words in batch.column(1)]
            arrays = [pa.array([x.chars for x in trees], pa.list_(pa.int64())), pa.array([x.tokens for x in trees], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, pa.array([x.encoded for x in trees], pa.int64())], names=schema.names)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(apply, schema)


def edit_trees(trees: DataFrame, edits: str, vocabulary: str, *, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and text, chars and tokens after the edits in the column ``edits`` of the same row, with n_reencoded."""
    tune(trees.sparkSession)
    ranks = _ranks(trees, vocabulary)
    schema = T.StructType([*trees.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("chars", _LONGS), T.StructField("tokens", _LONGS), T.StructField("n_reencoded", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(ranks.value)
        for batch in sliced(batches):
            out = []
            for words, chars, tokens, rows in zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True):
                tree = TokenTree.kept(words or "", chars, tokens, count)
                for e in rows or ():
                    if None not in (e["start"], e["stop"], e["new"]):
                        tree.edit(e["start"], e["stop"], e["new"])
                out.append((tree.text(), tree.chars, tree.tokens, tree.encoded))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *(pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True))], names=schema.names)

    source = [*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(("text", "chars", "tokens", edits)))]
    return trees.select(*source).mapInArrow(apply, schema)


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """The trees after a table of edits (key, seq, start, stop, new); documents without an edit stay as they are."""
    each = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EDIT.fields))
    per_key = edits.groupBy(F.col(key).alias("edited_key")).agg(F.array_sort(F.collect_list(each)).alias("edits"))
    held = trees.select(key, "text", "chars", "tokens")
    joined = held.join(per_key, held[key].eqNullSafe(per_key["edited_key"]), "left")
    return edit_trees(joined, "edits", vocabulary, keep=[key])


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", *, edits: Column | None = None) -> DataFrame:
    """Tokens of each text, and of the text after ``edits`` (an array of EDIT over the kept table's columns), with the pre-tokens encoded for either.

    The trees are written as a table, and the edits applied to it.
    """
    trees = Scratch(docs.sparkSession).write(build_trees(docs, vocabulary, key, text))
    before = trees.select(key, "text", "chars", "tokens", "n_pretokens", F.get("chars", F.lit(1)).alias("n_chars"), F.get("tokens", F.lit(1)).alias("n_tokens"))
    after = edit_trees(before.withColumn("edits", sample_edits() if edits is None else edits), "edits", vocabulary, keep=[key, "n_chars", "n_pretokens", "n_tokens"])
    return after.select(key, "n_chars", "n_pretokens", "n_tokens", F.get("chars", F.lit(1)).alias("edited_n_chars"), F.get("tokens", F.lit(1)).alias("edited_n_tokens"), "n_reencoded")
