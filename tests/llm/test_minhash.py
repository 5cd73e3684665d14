"""Operator 3 against brute force, and the signature's estimate."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from weir.llm import minhash
from weir.llm.components import components
from weir.llm.queries import ORACLES, QUERIES
from weir.llm.shared import table

from .oracle import compare


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for own in holders.values() if len(own) < 400 for k, i in enumerate(own) for j in own[k + 1 :]}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        comp = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), comp, doc == comp if doc is not None else comp is None))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in minhash.group(df, "doc_id", "text").collect())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    for shared, only in ((300, 100), (30, 10), (3, 1), (2000, 500)):
        base = rng.integers(0, 1 << 63, shared + 2 * only, dtype=np.uint64)
        a, b = base[: shared + only], np.concatenate([base[:shared], base[shared + only :]])
        x = minhash.superminhash([np.unique(a), np.unique(b)])
        assert abs((x[0] == x[1]).mean() - shared / (shared + 2 * only)) < 0.15
        assert np.isfinite(x).all()


def test_early_stop_changes_nothing():
    """Against the plain algorithm: every element walks its whole permutation."""
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 700):
        elements = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        slots = 16
        best = [float("inf")] * slots
        for e in elements:
            places = list(range(slots))
            for rank in range(slots):
                drawn = int(minhash.mix(np.array([e], np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * rank + 1)) % 2**64))[0])
                k = rank + (drawn & 0xFFFFFFFF) % (slots - rank)
                places[rank], places[k] = places[k], places[rank]
                best[places[rank]] = min(best[places[rank]], rank + (drawn >> 32) / 2**32)
        with np.errstate(over="ignore"):
            assert np.allclose(minhash.superminhash([elements], slots)[0], best)


def near_copies(rng, n=150):
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    docs = []
    for family in range(8):
        base = rng.choices(vocabulary, k=rng.choice([6, 40, 200]))
        for _ in range(n // 10):
            own = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base]
            docs.append(" ".join(own) + (f" {passage}" if family % 2 else ""))
    return docs


@pytest.mark.parametrize("limit", [32, 2])
def test_groups_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", limit)
    rng = random.Random(9)
    texts = [*near_copies(rng), None, "", " \t\n", "One", "one", "a b c d", "A  b\nc D", "same words here for ever and ever"] + ["same words here for ever and ever"] * 30
    texts += ["Été x y z w", "été x y z w", "long " * 20_000, "a b c d e f", "a b c d e f"]
    docs = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, "repeated id with another text entirely"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, node string").repartition(3)
    assert result(df) == brute(docs)


def test_query_matches_brute_force_on_a_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([(1, "just one document with words")], "doc_id long, text string")
    assert result(df.limit(0)) == [] and result(df) == ["(1, 1, 1, True)"]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 40)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "x long, y long").repartition(7)).collect()}
    assert got == {n: 100 if n < 200 else n // 100 * 100 for e in edges for n in e if n != 7}


def test_oracle(spark):
    assert compare(spark, QUERIES["op3_minhash"], ORACLES["op3_minhash"])


def test_signatures_in_blocks_take_little_memory():
    """The same signatures as at once, in a fraction of the memory."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64)) for _ in range(200)]
    tracemalloc.start()
    blocks = minhash._superminhash_in_blocks(sets)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    at_once = minhash.superminhash(sets)
    _, whole = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (blocks == at_once).all() and peak < whole / 2
