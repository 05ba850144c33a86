import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import prose

from weirflow.llm import simhash
from weirflow.llm.common import Scratch


def slow_fingerprint(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\t\n x.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def components(prints, budget):
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= budget
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 3, 4, 6]), st.sampled_from([1, 3, 40]))
def test_trie_join_finds_all_components(seed, budget, centres):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, centres, dtype=np.uint64) * np.uint64(2)
    prints = centre[rng.integers(0, centres, 120)]
    for _ in range(rng.integers(1, 5)):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    prints = np.unique(prints)
    assert (simhash.TrieJoin(prints, np.array([0]), 64, budget).components() == components(prints, budget)).all()


def test_small_fronts_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 2**12, 500, dtype=np.uint64) << np.uint64(50))
    want = components(prints, 4)
    monkeypatch.setattr(simhash, "FRONT", 50)
    assert (simhash.TrieJoin(prints, np.array([0]), 64, 4).components() == want).all()


def test_links_over_a_table_with_slices(spark):
    rng = np.random.default_rng(9)
    prints = np.unique(np.concatenate([rng.integers(0, 2**63, 100, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 30, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 60).astype(np.uint64))]))
    signed = prints.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    want = components(prints, 4)
    for size, blocks in ((50_000, None), (10, None), (50_000, 6), (10, 7), (50_000, 8)):
        roots = simhash.contract(simhash.trie_links(df, 4, slice_size=size, blocks=blocks), Scratch(spark))
        got = {r["node"]: r["root"] for r in roots.collect()}
        groups = {}
        for x, label in zip(signed.tolist(), want.tolist(), strict=True):
            groups.setdefault(label, set()).add(x)
        for members in groups.values():
            assert len({got.get(x, x) for x in members}) == 1
            assert {got.get(x, x) for x in members} <= members


def test_more_fingerprints_cut_more_blocks():
    assert [simhash.blocks_for(n, 4) for n in (10**3, 10**6, 10**8, 10**10, 10**13)] == [5, 5, 6, 7, 8]
    assert simhash.blocks_for(10**13, 8) == 9


def test_a_long_chain_takes_few_rounds(spark):
    n = 1000
    scratch = Scratch(spark)
    written = []
    write = scratch.write
    scratch.write = lambda df: written.append(1) or write(df)
    chain = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    more = spark.createDataFrame([(5000, 5001), (5001, 5000), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.contract(chain.unionByName(more), scratch).collect()}
    assert len({roots[i] for i in range(n)}) == 1
    assert roots[5000] == roots[5001] != roots[0]
    assert (len(written) - 1) / 2 <= 12


def test_near_duplicates_and_keeping_one(docs, corpus):
    got = sorted(((r["doc_id"], r["fp"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = np.array([slow_fingerprint(t) for _, t in corpus], np.uint64)
    label = components(prints, 4)
    least = {}
    for (k, _), c in zip(corpus, label.tolist(), strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    want = sorted(((k, int(p), least.get(c)) for (k, _), p, c in zip(corpus, prints.view(np.int64), label.tolist(), strict=True)), key=str)
    assert got == want
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(label.tolist()))
    assert {r["doc_id"] for r in kept} == set(least.values())


def test_null_and_repeated_keys_do_not_merge_components(spark):
    rng = random.Random(8)
    a, b, *others = (prose(rng, 80) for _ in range(6))
    rows = [*((None, t) for t in others), (5, a), (5, b), (9, b.upper()), (None, others[0])]
    label = components(np.array([slow_fingerprint(t) for _, t in rows], np.uint64), 4).tolist()
    assert len(set(label)) == 6  # four of null ids, a, and b with its copy
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([*((None, t) for t in others), (5, a), (5, b)], key=str)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).columns == no_docs.columns
