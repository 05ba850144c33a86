import base64
import hashlib
import json
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import prose
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, language_id, merkle, mixing, sharding, tokencount, url_filter
from weirflow.llm.queries import URL_RULES

# ---- language ID ---------------------------------------------------------------------------

LETTERS = {"aa": "abcdef ", "gg": "ghijkl ", "mm": "mnopqé "}


def labelled(n, rng, size=200):
    langs = sorted(LETTERS)
    return [(i, "".join(rng.choice(LETTERS[langs[i % 3]]) for _ in range(size)), langs[i % 3]) for i in range(n)]


def test_language_id_learns_and_holds_its_cases(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame(labelled(240, rng), "doc_id long, text string, lang string")
    model = language_id.train_language_id(docs, per_class=60, epochs=4)
    fresh = [(i, t, lang) for i, t, lang in labelled(60, rng, 700)]
    odd = [(100, None, "x"), (101, "", "x"), (102, "12 !?", "x"), (None, "abc " * 3000, "aa"), (103, "a", "aa")]
    test = spark.createDataFrame([(*r, "old", 1.5) for r in fresh + odd], "doc_id long, text string, lang string, LANG_PRED string, has_letter double")
    got = {r["doc_id"]: r for r in language_id.identify_language(test, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in fresh) >= 58
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert got[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[103]["has_letter"] == 1.5


def test_language_id_without_labels(spark, no_docs):
    assert language_id.train_language_id(no_docs) is None
    assert language_id.identify_language(no_docs, None).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert language_id.identify_language(one, None).first()["lang_pred"] == "und"


def naive_scores(model, window):
    """The network's logits for one window of bytes, filter by filter and place by place."""
    padded = [int(b) for b in window] + [0] * max(language_id.WIDTHS)
    top = []
    for f in range(model.kernel.shape[1]):
        width = language_id.WIDTHS[f // language_id.FILTERS]
        best = -np.inf
        for p in range(language_id.WINDOW):
            best = max(best, sum(float(model.embed[padded[p + i], d]) * float(model.kernel[i * language_id.DIMENSIONS + d, f]) for i in range(width) for d in range(language_id.DIMENSIONS)))
        top.append(max(best + float(model.bias[f]), 0.0))
    return np.array(top) @ model.out.astype(np.float64) + model.out_bias


def test_convolution_against_a_naive_one(monkeypatch):
    monkeypatch.setattr(language_id, "WINDOW", 24)
    monkeypatch.setattr(language_id, "FILTERS", 2)
    model = language_id.ByteCNN.fresh(["a", "b", "c"], 5)
    rng = np.random.default_rng(1)
    model.bias[:] = rng.normal(0, 0.2, model.bias.shape)
    windows = rng.integers(0, 256, (5, 24)).astype(np.uint8)
    windows[0, 10:] = 0
    for window, got in zip(windows, model.log_softmax(windows), strict=True):
        logits = naive_scores(model, window)
        assert got == pytest.approx(logits - np.log(np.exp(logits).sum()), abs=1e-4)


def test_gradients_against_differences(monkeypatch):
    """One step of plain descent in the place of Adam's: what changes is the gradient."""
    monkeypatch.setattr(language_id, "WINDOW", 16)
    monkeypatch.setattr(language_id, "FILTERS", 2)
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(1, 256, (6, 16)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    fresh = lambda: language_id.ByteCNN.fresh(["a", "b"], 9)
    loss = lambda m: -m.log_softmax(windows)[np.arange(6), labels].mean()
    before, after = fresh(), fresh()
    after.fit(windows, labels, 1, 3)
    assert loss(after) < loss(before)
    for name, places in (("out", [(0, 0), (5, 1)]), ("bias", [(1,), (6,)]), ("kernel", [(0, 0), (9, 3), (17, 7)]), ("embed", [(int(windows[0, 3]), 2)])):
        for at in places:
            step = np.float32(2e-3)
            up, down = fresh(), fresh()
            getattr(up, name)[at] += step
            getattr(down, name)[at] -= step
            slope = (loss(up) - loss(down)) / (2 * step)
            moved = float(getattr(after, name)[at] - getattr(before, name)[at])
            if abs(slope) > 1e-3:  # Adam's first step goes against the gradient's sign, by its rate
                assert np.sign(moved) == -np.sign(slope) and abs(moved) == pytest.approx(0.01, rel=0.05)


def test_every_window_counts():
    model = language_id.ByteCNN.fresh(["a", "b"], 1)
    raw = np.frombuffer(bytes(random.Random(2).randrange(1, 256) for _ in range(1000)), np.uint8)
    _, score = model.predict(raw, np.array([0]), np.array([1000]))
    parts = [np.exp(model.log_softmax(language_id._windows(raw, np.array([i]), np.array([1000]))))[0] * min(256, 1000 - i) for i in range(0, 1000, 256)]
    assert score[0] == pytest.approx(max(sum(parts) / 1000), rel=1e-5)


# ---- mixing --------------------------------------------------------------------------------


def poisson(mean, u):
    k, p = 0, np.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def unit(seed, key, text, part):
    digest = "~" if text is None else hashlib.md5(text.encode()).hexdigest()
    return int(hashlib.md5(f"{seed}|{'~' if key is None else key}|{digest}|{part}".encode()).hexdigest()[:13], 16) / 2**52


def test_mixing_draws_the_inverted_poisson(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 3), rng.choice(["a", "b", "b", "c", None])) for i in range(400)] + [(None, None, "a"), (None, "", "z"), (7, "x", "tiny"), (7, "y", "tiny")]
    rows += [(None, prose(rng, 4), "b"), (500, prose(rng, 20_000), "c"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"pool": F.lit("mine"), "digest": F.lit(1)})
    weights = {"a": 5.0, "b": 1.0, "tiny": 3.0, "none": 1.0}
    out = mixing.mix(docs, weights, other=1.0, seed=3)
    size = Counter()
    for _, t, s in rows:
        size[s if s in weights else ""] += max(len((t or "").encode()), 1)
    share = {p: {**weights, "": 1.0}[p] for p in size}
    want = Counter()
    for k, t, s in rows:
        p = s if s in weights else ""
        rate = share[p] / sum(share.values()) * sum(size.values()) / size[p]
        parts = max(1, int(np.ceil(rate / mixing.PART)))
        n = sum(poisson(rate / parts, unit(3, k, t, i)) for i in range(1, parts + 1))
        for c in range(n):
            want[(k, t, s, "mine", n, c)] += 1
    got = Counter((r["doc_id"], r["text"], r["source"], r["pool"], r["n_copies"], r["copy"]) for r in out.collect())
    assert got == want
    assert max(k[4] for k in got) > 100  # a mean that needs parts


def test_mixing_reaches_its_weights_and_shuffles(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 5), "ab"[i % 4 == 0]) for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"a": 1.0, "b": 1.0})
    share = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert share["a"] / sum(share.values()) == pytest.approx(0.5, abs=0.03)
    ids = [r["doc_id"] for r in out.collect()]
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.1
    assert ids == [r["doc_id"] for r in mixing.mix(docs, {"a": 1.0, "b": 1.0}).collect()]


def test_rows_of_a_hot_key_spread(spark):
    rng = random.Random(22)
    docs = spark.createDataFrame([(None, prose(rng, 8), "a") for _ in range(400)], "doc_id long, text string, source string")
    sizes = [len(p) for p in mixing.mix(docs, {"a": 1.0}, spread=8).rdd.glom().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_pipeline_mixing_draws_apart_for_texts_of_one_id(spark):
    import corpus_pipeline as c

    rng = random.Random(21)
    rows = [(None if i % 2 else 5, prose(rng, 20), "en", s) for i, s in enumerate(["src0", "src1", "src9", "src8"] * 300)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string")
    n = Counter(r["text"] for r in c.mixed(spark, docs, "").collect())
    size, kept = Counter(), Counter()
    for _, text, _, s in rows:
        size[s] += len(text)
        kept[s] += len(text) * n[text]
    assert n[rows[0][1]] % 2 == 0  # equal rows draw equal counts
    for s, share in (("src0", 0.2 / 0.85), ("src1", 0.1 / 0.85)):  # by a source's share of the weights that have bytes
        assert abs(kept[s] / sum(size.values()) - share) < 0.04
    assert len({n[t] for _, t, _, s in rows if s == "src0"}) > 2


def test_mixing_without_rows_or_weights(spark, no_docs):
    assert mixing.mix(no_docs, {"a": 1.0}).count() == 0
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    assert mixing.mix(docs, {"b": 1.0}).count() == 0


# ---- sharding ------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutation(n, seed):
    out = sharding.permute(np.arange(n), n, seed)
    assert sorted(out.tolist()) == list(range(n))
    assert (sharding.permute(np.arange(n), n, seed) == out).all()


def test_permutation_moves_rows():
    out = sharding.permute(np.arange(5000), 5000, 1)
    assert abs(np.corrcoef(np.arange(5000), out)[0, 1]) < 0.05


def test_sharding_a_table(spark, docs, corpus):
    rows = sharding.sized(docs).withColumn("row_no", F.lit("mine"))
    got = sharding.shard(rows, 4, ["doc_id", "text_crc32", "size"]).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    place = sharding.permute(np.arange(len(order)), len(order), 1)
    want = Counter((k, t, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), int(p % 4), int(p // 4)) for (k, t), p in zip(order, place, strict=True))
    assert Counter((r["doc_id"], r["text"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    assert {r["row_no"] for r in got} == {"mine"}
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_sharding_nothing(no_docs):
    assert sharding.shard(no_docs, 4, ["doc_id"]).count() == 0


# ---- fingerprints --------------------------------------------------------------------------


def naive_pieces(line):
    """Bytes of one paragraph cut piece by piece: after stops and the blanks behind them, else at the last blank within 63 bytes."""
    out = []
    while line:
        n = 0
        while n < min(63, len(line)) and line[n] not in b".!?":
            n += 1
        stop = n
        while stop < len(line) and line[stop] in b".!?":
            stop += 1
        if stop > n:
            while stop < len(line) and line[stop : stop + 1].isspace():
                stop += 1
        elif n < len(line):
            stop = max((i for i in range(1, n + 1) if line[i - 1 : i].isspace()), default=min(64, n + 1))
        out.append(line[:stop])
        line = line[stop:]
    return out


def naive_tree(raw):
    """Nested lists of bytes: sections of paragraphs of pieces."""
    sections, rest = [], raw
    while rest:
        m = re.search(rb"\n[ \t\r\f\v]*\n\s*", rest)
        section, rest = (rest[: m.end()], rest[m.end() :]) if m else (rest, b"")
        sections.append([naive_pieces(line) for line in section.splitlines(keepends=True)] if b"\r" not in section else [naive_pieces(line + b"\n") for line in section.split(b"\n")])
    return sections


def naive_likeness(a, b):
    """Pairs off equal sections, then equal paragraphs of the others, then equal pieces of what is left."""
    if a == b:
        return 1.0
    total = sum(len(p) for t in (a, b) for s in t for p in s)
    flat = lambda x: (x,) if isinstance(x, bytes) else sum((flat(y) for y in x), ())
    shared = 0
    for level in range(3):
        pool = list(b)
        rest = []
        for x in a:
            if x in pool:
                pool.remove(x)
                shared += len(flat(x))
            else:
                rest.append(x)
        if level < 2:
            a, b = [c for x in rest for c in x], [c for x in pool for c in x]
    return 2 * shared / total


STRUCTURED = ["One. Two!  Three?\n\nA new section here.\nA second line of it, rather longer than the sixty-four bytes that a piece may have at most.\n", "One. Two!  Four?\n\nA new section here.\n\n\n  Third", "\n\n\n", "\n", " ", "...", "x" * 200, "No stop at all " * 12]


def test_fingerprints_against_a_naive_tree(docs, corpus, spark):
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(STRUCTURED))]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, part int, k string, ahead int").repartition(3)
    hashes = {r["t"]: r["h"] for r in frame.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (naive_tree(x.encode()) for x in (t, edited, after))
        want[(k, len(t), hashlib.sha256(edited.encode()).hexdigest(), naive_likeness(a, b), naive_likeness(a, c))] += 1
    got = merkle.compare_with_edited(frame).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == want
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len({f for s in texts.values() for f in s}) == len({t or "" for _, t in rows})
    assert {r["edited_fingerprint"] == r["fingerprint"] for r in got if r["edit_from"] is None} == {True}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_next_of_string_keys_and_of_a_hot_key(spark, parts):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", f"k{i}", None]), prose(rng, 8)) for i in range(300)] + [("q\"uote", "x"), ("hot", "same"), ("hot", "same")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", hashes[r[1]]))
    want = Counter((k, hashlib.sha256((t[: len(t) - len(t) // 4] + order[(i + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert Counter((r["doc_id"], r["edited_sha256"]) for r in merkle.compare_with_edited(docs).collect()) == want
        sizes = [r["count"] for r in merkle.with_next(docs, "doc_id", "text").where("ahead = 0").groupBy("part").count().collect()]
        assert max(sizes) <= 2.5 * len(rows) / int(parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_a_lone_document_and_none(spark, no_docs):
    assert merkle.compare_with_edited(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).first()["near_next"] == 1.0
    assert merkle.compare_with_edited(no_docs).count() == 0


def test_tree_locates_edits():
    rng = random.Random(8)
    paragraphs = ["\n".join(prose(rng, 30) + "." for _ in range(3)) for _ in range(5)]
    raw = "\n\n".join(paragraphs).encode()
    at = raw.index(paragraphs[2].encode()) + 40
    changed = raw[:at] + b"#####" + raw[at + 5 :]
    a, b = merkle.tree(raw), merkle.tree(changed)
    (x, y), *rest = merkle.differences(a, b)
    assert not rest
    assert x[0] <= at and x[1] >= at + 5 and x[1] - x[0] < 200 and y[1] - y[0] < 200
    assert merkle.differences(a, merkle.tree(raw)) == []
    grown = merkle.differences(a, merkle.tree(raw + b"\n\nA new section."))
    assert 1 <= len(grown) <= 4 and all(x[0] >= len(raw) - 100 and y[0] >= len(raw) - 100 for x, y in grown)
    # roots are made from their children, and any byte counts
    assert a.hash == merkle._hash(b"r" + b"".join(s.hash for s in a.children))
    for other in (raw + b" ", raw.replace(b"\n\n", b"\n \n", 1), raw + b"\n"):
        assert merkle.tree(other).hash != a.hash
    everything = [leaf for s in a.children for p in s.children for leaf in p.children]
    assert b"".join(raw[n.start : n.end] for n in everything) == raw
    spelled = merkle.spelled(a)
    assert spelled.startswith(a.hash.hex()) and all(n.code in spelled for n in everything)


# ---- token counts --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """Ranks of all bytes and a few pairs; tokenizers are given, never trained."""
    path = tmp_path_factory.mktemp("ranks") / "tiny.tiktoken"
    tokens = [bytes([i]) for i in range(256)] + [b"he", b"ll", b"hell", b" w", b"or", b" wor", b"  ", b"12"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    return str(path)


PARTS = [" ", "  ", "\n", "'s", "'", "re", "don't", "hello", "12", "é", "!!", "...", "world", "\t", " a", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_edits_leave_the_tree_as_a_recount(vocabulary, seed):
    rng = random.Random(seed)
    count = tokencount._encoder(open(vocabulary, "rb").read())
    text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 600])))
    tree = tokencount.TokenTree(text, count)
    for _ in range(4):
        a = rng.randint(0, len(text) + 2)
        b = a + rng.choice([0, 0, 1, 5, 200])
        new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 300])))
        tree.edit(a, b, new)
        a = min(a, len(text))
        text = text[:a] + new + text[min(max(a, b), len(text)) :]
        whole = tokencount.TokenTree(text, count)
        assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, whole.n_chars, whole.n_tokens)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_edits_of_a_kept_tree(vocabulary, seed):
    rng = random.Random(seed)
    count = tokencount._encoder(open(vocabulary, "rb").read())
    text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 600, 3000])))
    tree = tokencount.TokenTree(text, count)
    for _ in range(4):
        tree = tokencount.TokenTree.kept(text, tree.chars, tree.tokens, count)
        assert (tree.text(), tree.encoded) == (text, 0)
        a = rng.randint(0, len(text) + 2)
        b, new = a + rng.choice([0, 0, 1, 5, 2000]), "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 300])))
        tree.edit(a, b, new)
        text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
        whole = tokencount.TokenTree(text, count)
        assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, whole.n_chars, whole.n_tokens)
        assert all(t[i] == t[2 * i] + t[2 * i + 1] for t in (tree.chars, tree.tokens) for i in range(1, tree.width))


def test_small_edits_encode_little(vocabulary):
    count = tokencount._encoder(open(vocabulary, "rb").read())
    text = "hello world 12 " * 20_000
    tree = tokencount.TokenTree(text, count)
    before = tree.encoded
    tree.edit(100_000, 100_005, "there")
    assert tree.encoded - before < 20
    kept = tokencount.TokenTree.kept(tree.text(), tree.chars, tree.tokens, count)
    kept.edit(200_000, 200_005, "there")
    assert kept.encoded < 4 * tokencount.BLOCK


def recount(vocabulary):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb").read().splitlines())}
    return tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def edited_text(text, edits):
    for a, b, x in edits:
        a = max(0, min(a, len(text)))
        text = text[:a] + x + text[min(max(a, b), len(text)) :]
    return text


def test_token_counts_over_a_table(docs, corpus, no_docs, vocabulary):
    encode = recount(vocabulary)
    want = Counter()
    for k, t in corpus:
        t = t or ""
        n = len(t)
        new = edited_text(t, [(n // 3, n // 3, " [revised] "), (2 * n // 3, 2 * n // 3 + 20, ""), (n + 11, n + 11, t[:50])])
        want[(k, n, len(encode(t)), len(new), len(encode(new)))] += 1
    got = tokencount.count_tokens(docs.withColumns({"chars": F.lit(1), "tokens": F.lit("x"), "edits": F.lit(2)}), vocabulary).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["n_tokens"], r["edited_n_chars"], r["edited_n_tokens"]) for r in got) == want
    assert tokencount.count_tokens(no_docs, vocabulary).count() == 0


def test_a_table_of_edits_on_kept_trees(spark, docs, corpus, no_docs, vocabulary):
    rng = random.Random(31)
    encode = recount(vocabulary)
    ids = [k for k, _ in corpus]
    rows = []
    for seq in range(60):
        a = rng.randrange(0, 400)
        rows.append((rng.choice([*ids, None, 999]), seq, a, a + rng.choice([0, 3, 90]), rng.choice(["", " x", " hello world 12" * 9])))
    none = (ids[0], 70, None, 3, "x")
    edits = spark.createDataFrame([*rows, none], "doc_id long, seq long, start long, stop long, new string")
    trees = tokencount.build_trees(docs, vocabulary)
    got = tokencount.apply_edits(trees, edits, vocabulary).collect()
    want = Counter()
    for k, t in corpus:
        new = edited_text(t or "", [(a, b, x) for key, _, a, b, x in rows if key == k])
        want[(k, new, len(encode(new)))] += 1
    assert Counter((r["doc_id"], r["text"], r["tokens"][1]) for r in got) == want
    again = tokencount.apply_edits(trees, edits.limit(0), vocabulary).collect()
    assert Counter((r["doc_id"], r["text"], r["n_reencoded"]) for r in again) == Counter((k, t or "", 0) for k, t in corpus)
    assert tokencount.apply_edits(tokencount.build_trees(no_docs, vocabulary), edits, vocabulary).count() == 0


# ---- URL filter ----------------------------------------------------------------------------

URLS = [
    "http://a.example.net/en/1?x=1", "https://EXAMPLE.NET/de/2", "https://example.com/de/3#t", "http://m.example.com/fr/4", "http://x.org/fr/5/", "http://org/fr/6", "http://notorg/fr/7",
    "http://x.org/en/8", "http://a.net", "http://a.net/", "//no-scheme/net/", "", None, "ftp://h?q=://z/net/", "http://ÄÖ.net/ü", "http://b.example.net/en", "http://b.example.net/en/", "http://ex.net/x://y", "http://" + "a" * 5000 + ".net/",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def matched(host, path):
    best = None
    for rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, URL_RULES, keep=["page_id"]).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = parse(URLS[r["page_id"]])
        rule = matched(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (URL_RULES[rule] if rule else "allow" if r["score"] >= r["threshold"] else "block")


def slow_scores(urls, seen, contexts):
    """Scores and the threshold, in plain Python, from the definition."""
    code = lambda c: url_filter.SYMBOLS.find("0" if c.isdigit() and c.isascii() else "?" if c in "&=#%_+:;,~@!$*()" else c) + 1
    spelled = [tuple(map(code, (u or "").lower())) for u in urls]
    rule = [matched(*parse(u)) for u in urls]
    held = [u is not None and hashlib.md5(u.encode()).hexdigest()[0] in "012" for u in urls]
    follow = {"allow": {}, "block": {}}
    for s, r, h in zip(spelled, rule, held, strict=True):
        if r and not h:
            for i, c in enumerate(s):
                for n in range(min(i, url_filter.ORDER) + 1):
                    follow[URL_RULES[r]].setdefault(s[i - n : i], Counter())[c] += 1
    size = lambda ctx: sum(sum(f.get(ctx, {}).values()) for f in follow.values())
    least = max(seen, int(np.ceil(size(()) / contexts)))
    known = {ctx for f in follow.values() for ctx in f if size(ctx) >= least and ctx} | {()}

    def probability(kind, ctx, c):
        table = follow[kind].get(ctx, Counter())
        if not ctx:
            return (table[c] + 1) / (table.total() + 32)
        short = probability(kind, ctx[1:], c)
        return (table[c] + len(table) * short) / (table.total() + len(table)) if table else short

    scores = []
    for s in spelled:
        total = 0
        for i, c in enumerate(s):
            ctx = next(s[i - n : i] for n in range(min(i, url_filter.ORDER), -1, -1) if s[i - n : i] in known)
            if follow["allow"] and follow["block"]:
                total += round((np.log(probability("allow", ctx, c)) - np.log(probability("block", ctx, c))) * 10**6)
        scores.append(total // len(s) if s else 0)
    judged = [(x // url_filter.BIN, URL_RULES[r]) for x, r, h in zip(scores, rule, held, strict=True) if r and h]
    yes, no = ([b for b, v in judged if v == kind] for kind in ("allow", "block"))
    errors = [(sum(x < b for x in yes) / len(yes) - sum(x < b for x in no) / len(no), abs(b), b) for b in {b for b, _ in judged}] if yes and no else [(0, 0, 0)]
    return scores, min(errors)[2] * url_filter.BIN, len({len(k) for k in known})


def random_urls(rng, n):
    return [f"http://{rng.choice('abc')}{rng.choice('xyz')}.{rng.choice(['net', 'org', 'com', 'example.net', 'example.com'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.randrange(99)}{rng.choice(['', '?q=É', '_x'])}" for _ in range(n)]


def test_url_model_follows_its_definition(spark, monkeypatch):
    rng = random.Random(4)
    urls = [*random_urls(rng, 300), None, "", "no scheme", "http://" + "long." * 3000 + "net/", *random_urls(rng, 1) * 3]
    for contexts in (url_filter.CONTEXTS, 12):
        monkeypatch.setattr(url_filter, "CONTEXTS", contexts)
        want, cut, lengths = slow_scores(urls, url_filter.SEEN, contexts)
        pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, symbols string, steps int")
        got = {r["page_id"]: r for r in url_filter.judge_urls(pages, URL_RULES, keep=["page_id"]).collect()}
        assert [got[i]["score"] for i in range(len(urls))] == pytest.approx([x / 10**6 for x in want], abs=2e-6)
        assert got[0]["threshold"] == pytest.approx(cut / 10**6)
        assert lengths > 2


def test_url_table_stays_out_of_the_rows(spark):
    pages = spark.createDataFrame(list(enumerate(random_urls(random.Random(5), 60))), "page_id long, url string")
    plan = url_filter.judge_urls(pages, URL_RULES, keep=["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000
    assert re.search(r"aggregate\(symbols[^\n]*Subquery", plan)


def test_a_very_long_url_takes_linear_time(spark):
    import time

    rng = random.Random(6)
    seconds = []
    for n in (20_000, 200_000):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate([*random_urls(rng, 30), "http://a.org/" + "xy/" * (n // 3)])], "page_id long, url string")
        judged = url_filter.judge_urls(pages, URL_RULES, keep=["page_id"])
        judged.collect()
        began = time.perf_counter()
        judged.collect()
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 10 * seconds[0] + 2


def test_no_urls(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES, keep=["page_id"]).count() == 0


# ---- decontamination -----------------------------------------------------------------------


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def overlap(doc, item):
    n = min(13, len(item))
    need = n if len(item) < 8 else int(np.ceil(n * 0.8))
    best = None
    for s in range(len(item) - n + 1):
        for p in range(-n + 1, len(doc)):
            m = sum(0 <= p + j < len(doc) and doc[p + j] == item[s + j] for j in range(n))
            if n and m >= need and (best is None or (m, -p) > best):
                best = (m, -p)
    return best and (-best[1], best[0], n)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, n)) for i, n in enumerate((7, 8, 13, 14, 40, 60, 5, 3))] + [(16, None), (17, ""), (18, "few"), (19, " -- ")]
    items.append((9, items[4][1]))
    items += [(20 + i, prose(rng, 5) + " " + items[5][1]) for i in range(6)]  # a passage that many items share
    texts = []
    for i in range(80):
        parts = prose(rng, rng.randrange(0, 60)).split()
        passage = rng.choice(items[:8])[1].split()
        a = rng.randrange(0, max(1, len(passage) - 6))
        passage = passage[a : a + rng.randrange(6, 40)]
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            passage[rng.randrange(len(passage))] = "CHANGED"
        texts.append((i, " ".join(parts[:20] + passage + parts[20:]) if i % 5 else prose(rng, 80)))
    texts += [(100, None), (101, ""), (102, "one two"), (None, items[4][1]), (3, texts[3][1]), (103, items[0][1]), (104, " ".join(items[1][1].split()[:7])), (105, items[7][1].upper()), (106, "a few words"), (107, "?!")]
    long = prose(rng, 30_000).split()
    texts.append((108, " ".join(long[:20_000]) + " " + items[3][1] + " " + " ".join(long[20_000:])))
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in texts], "doc_id long, text string, item_id int, digest string, w int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = decontaminate.overlaps(docs, bench, keys=["doc_id"]).collect()
    want = {(k, i): o for k, t in texts for i, x in items if (o := overlap(words(t), words(x)))}
    assert {(r["doc_id"], r["item_id"]): (r["word_at"], r["matched"], r["compared"]) for r in got} == want
    assert len(got) == len(want) > 60
    assert {(103, 0), (104, 1), (105, 7), (106, 18), (108, 3)} <= set(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    bad = {k for k, _ in want}
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.where("doc_id is not null").collect()) == sorted((k, t or "") for k, t in texts if k is not None and k not in bad)
    assert kept.columns == docs.columns


def test_decontamination_refuses_what_the_masks_do_not_serve(docs, spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for options in ({"window": 7}, {"window": 16}, {"share": 0.7}, {"share": 1.1}):
        with pytest.raises(ValueError):
            decontaminate.overlaps(docs, bench, keys=["doc_id"], **options)
        with pytest.raises(ValueError):
            decontaminate.drop_contaminated(docs, bench, **options)


def test_decontamination_plans_are_small(docs, spark):
    bench = spark.createDataFrame([(i, f"item {i} has some words of its own and {i * i} more of them") for i in range(300)], "item_id long, text string")
    assert len(decontaminate.overlaps(docs, bench, keys=["doc_id"])._jdf.queryExecution().toString()) < 100_000
    assert len(decontaminate.drop_contaminated(docs, bench)._jdf.queryExecution().toString()) < 100_000


def test_decontamination_of_nothing(no_docs, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(no_docs, bench, keys=["doc_id"]).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert decontaminate.drop_contaminated(docs, bench).count() == 1


@pytest.mark.parametrize("n", range(8, 16))
def test_masks_lose_no_run_with_a_fifth_substituted(n):
    from itertools import combinations

    for gone in combinations(range(n), n // 5):
        assert any(all(i + o not in gone for o in m) for m in decontaminate.MASKS for i in range(n - m[-1]))


# ---- native operators ----------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_native_queries_run_no_python(spark):
    from weirflow.llm import queries

    for name in ("op1_mixing", "op8_url_filter", "op9_decontamination"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    whole = docs.count()
    first = c.identify(spark, docs, d)
    assert whole - 3 <= first.count() <= whole
    assert first.columns == docs.columns
    second = c.near_dedup(spark, docs, d)
    assert second.columns == docs.columns
    assert second.count() < whole
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontaminate.overlaps(docs, bench, keys=["doc_id"]).collect()}
    assert {r["doc_id"] for r in c.decontaminated(spark, docs, d).collect()} == {r["doc_id"] for r in docs.collect()} - dirty
    assert c.mixed(spark, docs, d).columns == docs.columns
    last = c.sharded(spark, docs, d)
    assert last.count() == whole
    assert c.run(spark, d).count() > 0
    assert json.loads(last.schema.json())["fields"][-1]["name"] == "slot"
