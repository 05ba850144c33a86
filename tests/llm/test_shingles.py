import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from llm_texts import prose

from weirflow.llm import shingles, simhash
from weirflow.llm.common import Scratch


def slow_set(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(sets, least=0.8):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, text, places):
    words = text.split()
    for i in rng.sample(range(len(words)), places):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def least_rows(rows, label):
    best = {}
    for (k, _), c in zip(rows, label, strict=True):
        best[c] = min(best.get(c, (True, 0)), (k is None, k or 0))
    return sorted(None if none else k for none, k in best.values() if not none), sum(none for none, _ in best.values())


@pytest.fixture(scope="module")
def copies():
    """Families of texts, each edited at random places, many with similarities around 0.8; clean texts; null and repeated ids."""
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        base = prose(rng, rng.choice([40, 150, 400]))
        n = len(base.split())
        texts += [base, *(edited(rng, base, max(1, round(n * rng.uniform(0.005, 0.05)))) for _ in range(4))]
    texts += [prose(rng, 60) for _ in range(30)] + ["", None, "one two", "ONE  two", "one three"]
    rows = [(None if rng.random() < 0.1 else i // 2 if rng.random() < 0.1 else i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_pipeline_keeps_one_of_five_word_similarity(spark, copies):
    sets = [slow_set(t) for _, t in copies]
    label = components(sets)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 0.8 <= similarity(sets[i], sets[j]) < 1]
    prints = np.array([simhash.fingerprint((t or "").encode()) for _, t in copies], np.uint64)
    assert sum(int(prints[i] ^ prints[j]).bit_count() > 4 for i, j in pairs) > 20  # these the fingerprints of op4 don't link
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert len(kept) == len(set(label))
    at = {c: [r for r, x in zip(copies, label, strict=True) if x == c] for c in set(label)}
    of = {r: c for c, rows in at.items() for r in rows}
    assert {of[(r["doc_id"], r["text"])] for r in kept} == set(label)
    ids, nulls = least_rows(copies, label)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == ids
    assert sum(r["doc_id"] is None for r in kept) == nulls


def test_similarity_of_exactly_the_least(spark):
    docs = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(36))), ("b", " ".join(f"w{i}" for i in range(4, 39)) + " z")], "doc_id string, text string")
    assert similarity(*(slow_set(r["text"]) for r in docs.collect())) == pytest.approx(28 / 36)
    assert shingles.near_duplicates(docs, least=28 / 36).select("root").distinct().count() == 1


def test_first_links_are_those_of_the_fingerprints(spark, copies):
    rows = shingles.with_node(spark.createDataFrame(copies, "doc_id long, text string"), "text", words=5, name="fp", keep=["doc_id"], buckets=True)
    got = {(r["doc_id"], r["fp"]): r["print"] for r in rows.collect()}
    bits = lambda grams: sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))
    want = {}
    for _, t in copies:
        hashes = {xxhash.xxh64_intdigest(s, shingles.SEED) for s in slow_set(t)}
        want[shingles.node(np.array(sorted(hashes), np.uint64))] = bits(hashes)
    assert {k[1] % 2**64: p % 2**64 for k, p in got.items()} == want
    pairs = shingles.first_candidates(rows, Scratch(spark), 4).collect()
    near = {(a, b) for a in want for b in want if a != b and (want[a] ^ want[b]).bit_count() <= 4}
    linked = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in pairs}
    root = {a: a for a in want}
    for _ in want:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert linked and all(root[min(p)] == root[max(p)] for p in linked)
    other = {a: a for a in want}
    for _ in want:
        for p in linked:
            other[min(p)] = other[max(p)] = min(other[min(p)], other[max(p)])
    assert {a: min(x for x in want if root[x] == root[a]) for a in want} == {a: min(x for x in want if other[x] == other[a]) for a in want}


def test_a_large_group_is_linked_by_its_middle(spark, monkeypatch):
    """Few of the many similar pairs of one group are left for the last comparison."""
    rng = random.Random(6)
    base = prose(rng, 400)
    texts = [base, *(edited(rng, base, rng.randint(1, 8)) for _ in range(150))]
    sets = [slow_set(t) for t in texts]
    near = sum(similarity(sets[i], sets[j]) >= 0.8 for i in range(len(sets)) for j in range(i))
    compared = []
    similar = shingles.similar
    monkeypatch.setattr(shingles, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    got = shingles.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert got.select("root").distinct().count() == len(set(components(sets)))
    assert near > 1000
    assert compared[-1] < 0.02 * near


def test_more_rounds_give_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(shingles, "REST", 0)
    monkeypatch.setattr(shingles, "GAIN", 0)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(copies)], "doc_id long, text string")
    label = components([slow_set(t) for _, t in copies])
    groups = {}
    for r in shingles.near_duplicates(docs).collect():
        groups.setdefault(r["root"], set()).add(label[r["doc_id"]])
    assert sorted(map(len, groups.values())) == [1] * len(set(label))


def test_open_pairs_come_once_and_whole(spark, copies):
    rows = shingles.with_node(spark.createDataFrame(copies, "doc_id long, text string"), "text", words=5, name="fp", keep=["doc_id"], buckets=True)
    members = rows.selectExpr("explode(buckets) as bucket", "fp", "sig", "1L as met", "pmod(fp, 4) as root").distinct()
    got = [(r["a"], r["b"]) for r in shingles.open_pairs(members, shingles.heads(members, None, None), 0.8, Scratch(spark)).collect()]
    nodes = {r["fp"]: (set(r["buckets"]), r["sig"]) for r in rows.collect()}
    far = lambda x, y: sum(((u ^ v) & 2**64 - 1).bit_count() for u, v in zip(x[1:], y[1:], strict=True))
    close = lambda x, y: far(x, y) <= (x["n"] + y["n"]) / 9 + 1e-6
    want = [(a, b) for a in nodes for b in nodes if a < b and a % 4 != b % 4 and nodes[a][0] & nodes[b][0] and close(nodes[a][1], nodes[b][1])]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 50, 3000):
        a, b = np.unique(rng.integers(0, 2 * n, n).astype(np.uint64)), np.unique(rng.integers(0, 2 * n, n).astype(np.uint64))
        bits = int(np.bitwise_count(shingles.parity(a).view(np.uint64) ^ shingles.parity(b).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_empty_table(no_docs):
    assert shingles.near_duplicates(no_docs).count() == 0
    assert corpus_pipeline.near_dedup(no_docs.sparkSession, no_docs, "").columns == no_docs.columns
