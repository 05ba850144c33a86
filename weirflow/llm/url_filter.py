"""URL filter: rules, and a ratio of character language models for the rest.

URLs that a rule decides, but for a held-out fold, train two Markov models over
32 symbols, one of accepted and one of rejected URLs.  Their order varies: a
symbol is predicted from the longest context of up to ORDER symbols before it
that occurs often enough; a context's estimate is interpolated with that of the
next shorter one in proportion to how many different symbols followed it (Witten
and Bell), down to single symbols with one added to each count.  A URL's score
is its log-likelihood difference divided by its symbols; the threshold is the
cut with the least balanced error on the held-out fold.

Contexts and symbols form an automaton: its table has, for each context and
symbol, the ratio of the two estimates and the longest context that follows.  A
context must make up a share of 1 / CONTEXTS of all symbols, so there are ORDER
* CONTEXTS + 1 at most, whatever the corpus; the table enters the scoring
expression as a scalar subquery, and a URL is scored in one pass over its
symbols.  Only DataFrame functions run.

Defined cases: a null URL has empty host and path, no rule and score 0; URLs
without ``://`` have empty host and path but are scored as they are; very long
URLs are scored whole, in linear time; repeated rows are judged alike; without
rows of both kinds to learn from every score is 0, without both in the held-out
fold the threshold; a score at the threshold is accepted; an empty table gives
no rows; other columns, whatever their names, have no effect.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import Scratch

SYMBOLS = string.ascii_lowercase + "0./-?"  # and one more, 0, for all other characters
SIZE = 32
MICRO = 1_000_000
#: Longest context, how often it must be seen, and how many of one length there may be.
ORDER, SEEN, CONTEXTS = 4, 8, 4096
#: Bits of an entry of the table below its ratio, for the next context's number.
STATE_BITS = 16
#: First digits of the MD5 of URLs that are held out.
HELD_OUT = ("0", "1", "2")
#: Width and number of the histogram bins from which the threshold is chosen, in millionths a symbol.
BIN, BINS = 5_000, 4_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(rules: dict[str, str], host: str = "host", path: str = "path") -> Column:
    """The longest rule (host and path in one string) that fits the host or a parent of it and begins the path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def symbols_of(url: Column) -> Column:
    """The numbers, under SIZE, of a URL's symbols."""
    plain = F.translate(F.lower(F.coalesce(url, F.lit(""))), "123456789&=#%_+:;,~@!$*()", "0" * 9 + "?" * 16)
    each = F.transform(F.split(plain, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(SYMBOLS), c)))
    return F.when(F.length(plain) > 0, each).otherwise(F.array().cast("array<int>"))


def grams(labelled: DataFrame, symbols: str, accepted: str) -> DataFrame:
    """(n, ctx, c, yes, no): how often symbol c follows a context of n symbols, n up to ORDER, in URLs of either kind."""
    ago = lambda i, j: F.coalesce(F.get(F.col(symbols), i - j), F.lit(0)) * SIZE**j
    code = lambda i: sum((ago(i, j) for j in range(1, ORDER + 1)), ago(i, 0))
    places = F.transform(F.col(symbols), lambda s, i: F.struct(F.least(i, F.lit(ORDER)).alias("known"), code(i).alias("code")))
    counts = labelled.select(F.inline(places), F.col(accepted).cast("long").alias("y")).groupBy("known", "code").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    orders = F.transform(F.sequence(F.lit(0), F.col("known")), lambda n: F.struct(n.alias("n"), F.expr(f"code div {SIZE}").alias("before")))
    each = counts.select(F.inline(orders), (F.col("code") % SIZE).alias("c"), "yes", "no")
    ctx = F.col("before") % F.element_at(F.array(*(F.lit(SIZE**n) for n in range(ORDER + 1))), F.col("n") + 1)
    return each.select("n", ctx.cast("int").alias("ctx"), F.col("c").cast("int").alias("c"), "yes", "no").groupBy("n", "ctx", "c").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def contexts(counts: DataFrame) -> DataFrame:
    """(id, n, ctx): the empty context, number 0, and those that occur often enough; CONTEXTS of a length at most."""
    whole = Window.partitionBy(F.lit(0))  # a row for each context that is seen SEEN times and makes up its share
    total = counts.where("n = 0").agg(F.sum(F.col("yes") + F.col("no")).alias("total"))
    least = F.greatest(F.lit(SEEN), F.ceil(total.scalar() / CONTEXTS))
    often = counts.where("n > 0").groupBy("n", "ctx").agg(F.sum(F.col("yes") + F.col("no")).alias("seen")).where(F.col("seen") >= least).select("n", "ctx")
    root = counts.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(0).alias("ctx"))
    return root.unionByName(often).select((F.row_number().over(whole.orderBy("n", "ctx")) - 1).alias("id"), "n", "ctx")


def automaton(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: for each context, by number, and symbol the ratio in millionths and the next context's number, packed in a long."""
    known = scratch.write(contexts(counts))
    grid = known.select("id", "n", "ctx", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("c"))
    held = grid.join(counts, ["n", "ctx", "c"], "left").select("id", "n", "ctx", "c", *(F.coalesce(y, F.lit(0)).cast("double").alias(y) for y in ("yes", "no")))
    mine = Window.partitionBy("id")
    held = held.withColumns({f"all_{y}": F.sum(y).over(mine) for y in ("yes", "no")} | {f"kinds_{y}": F.sum((F.col(y) > 0).cast("int")).over(mine) for y in ("yes", "no")})
    held = scratch.write(held)
    first = held.where("n = 0")
    shorter = first.select("n", "ctx", "c", *(((F.col(y) + 1) / (F.col(f"all_{y}") + SIZE)).alias(f"p_{y}") for y in ("yes", "no")))
    every = first.select("id", "c", "all_yes", "all_no").join(shorter.select("c", "p_yes", "p_no"), "c").select("id", "c", "p_yes", "p_no")
    for n in range(1, ORDER + 1):
        own = held.where(F.col("n") == n).withColumn("tail", F.col("ctx") % SIZE ** (n - 1))
        below = shorter.select(F.col("ctx").alias("tail"), "c", F.col("p_yes").alias("q_yes"), F.col("p_no").alias("q_no"))
        mixed = own.join(below, ["tail", "c"]).withColumns({f"p_{y}": F.when(F.col(f"all_{y}") > 0, (F.col(y) + F.col(f"kinds_{y}") * F.col(f"q_{y}")) / (F.col(f"all_{y}") + F.col(f"kinds_{y}"))).otherwise(F.col(f"q_{y}")) for y in ("yes", "no")})
        shorter = scratch.write(mixed.select("id", "n", "ctx", "c", "p_yes", "p_no"))
        every = every.unionByName(shorter.select("id", "c", "p_yes", "p_no"))
    both = first.agg(((F.sum("yes") > 0) & (F.sum("no") > 0)).alias("both"))
    ratio = every.select("id", "c", F.when(F.coalesce(both.scalar(), F.lit(False)), F.round((F.log("p_yes") - F.log("p_no")) * MICRO)).otherwise(0).cast("long").alias("ratio"))
    # the next context is the longest known end of this one and the symbol
    powers = F.array(*(F.lit(SIZE**m) for m in range(ORDER + 1)))
    after = (F.col("ctx").cast("long") * SIZE + F.col("c")).alias("after")
    ends = grid.select(F.col("id").alias("from"), "c", after, F.explode(F.sequence(F.lit(0), F.least(F.col("n") + 1, F.lit(ORDER)))).alias("n"))
    ends = ends.withColumn("ctx", (F.col("after") % F.element_at(powers, F.col("n") + 1)).cast("int"))
    following = ends.join(known, ["n", "ctx"]).groupBy("from", "c").agg(F.max_by("id", "n").alias("to"))
    entries = ratio.join(following.withColumnRenamed("from", "id"), ["id", "c"]).select((F.col("id") * SIZE + F.col("c")).alias("at"), (F.shiftleft("ratio", STATE_BITS) + F.col("to")).alias("entry"))
    return entries.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias("steps"))


def with_score(rows: DataFrame, symbols: str, table: DataFrame) -> DataFrame:
    """``rows`` with score: millionths a symbol, rounded down."""
    # the optimizer moves the table, which is used once, into the expression: rows don't carry it
    held = rows.withColumn("steps", table.scalar())
    low = F.lit((1 << STATE_BITS) - 1).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, s: Column) -> Column:
        entry = F.get(F.col("steps"), (acc["entry"].bitwiseAND(low) * SIZE + s).cast("int"))
        return F.struct(entry.alias("entry"), (acc["total"] + F.shiftright(acc["entry"], STATE_BITS)).alias("total"))

    total = F.aggregate(symbols, start, step, lambda acc: acc["total"] + F.shiftright(acc["entry"], STATE_BITS))
    score = F.when(F.size(symbols) > 0, F.floor(total / F.size(symbols))).otherwise(F.lit(0)).cast("long")
    return held.withColumn("score", score).drop("steps")


def _threshold(scored: DataFrame) -> int:
    """The bin edge with the least balanced error; 0 unless both kinds occur."""
    binned = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS)).alias("bin")
    counts = scored.groupBy(binned).agg(F.sum(F.col("accepted").cast("int")).alias("yes"), F.sum((~F.col("accepted")).cast("int")).alias("no"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over the bins
    whole = Window.partitionBy(F.lit(0))
    cuts = counts.withColumns({"lost": F.coalesce(F.sum("yes").over(below), F.lit(0)), "caught": F.coalesce(F.sum("no").over(below), F.lit(0)), "all_yes": F.sum("yes").over(whole), "all_no": F.sum("no").over(whole)}).where("all_yes > 0 and all_no > 0")
    best = cuts.orderBy((F.col("lost") / F.col("all_yes") - F.col("caught") / F.col("all_no")), F.abs("bin"), "bin").limit(1).collect()
    return int(best[0]["bin"]) * BIN if best else 0


def judge_urls(pages: DataFrame, rules: dict[str, str], *, url: str = "url", keep: list[str]) -> DataFrame:
    """The columns ``keep`` with host, path, rule, verdict (allow or block), score and threshold.

    ``rules`` maps host/path to allow or block; the longest that fits decides, and the model where none does.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = split_url(F.col(url))
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*named, host.alias("host"), path.alias("path"), symbols_of(F.col(url)).alias("symbols"), F.substring(F.md5(F.col(url).cast("binary")), 1, 1).isin(*HELD_OUT).alias("held_out"))
    rows = rows.withColumn("rule", match_rule(rules))
    verdict = F.lit(None).cast("string")
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    rows = rows.withColumn("ruled", verdict)
    labelled = rows.where("ruled is not null").select("symbols", "held_out", (F.col("ruled") == "allow").alias("accepted"))
    counts = scratch.write(grams(labelled.where("not held_out"), "symbols", "accepted"))
    table = scratch.write(automaton(counts, scratch))
    cut = _threshold(with_score(labelled.where("held_out").select("symbols", "accepted"), "symbols", table))
    scored = with_score(rows, "symbols", table)
    final = F.coalesce(F.col("ruled"), F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", final.alias("verdict"), (F.col("score") / MICRO).alias("score"), F.lit(cut / MICRO).alias("threshold"))
