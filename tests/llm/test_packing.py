"""Operator 6: every id in one piece, windows within capacity, no padding with cutting, counts against brute force."""

import collections
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weir.llm import bpe, packing
from weir.llm.queries import QUERIES
from weir.llm.shared import table

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())


def test_differencing_is_near_equal_and_complete():
    rng = random.Random(3)
    for k in (1, 2, 7, 40):
        sizes = [rng.randint(1, 1023) for _ in range(120)]
        windows = packing.difference(sizes, k)
        assert sorted(itertools.chain(*windows)) == list(range(120)) and len(windows) == k
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= (20 if k <= 7 else 400)


def test_two_way_differencing_matches_the_textbook():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


@pytest.mark.parametrize("n", [0, 1, 2, 50, 512])
def test_plans_hold_each_token_once(n):
    rng = random.Random(n)
    sizes = [rng.randint(1, 1023) for _ in range(n)]
    full, rest = packing.plan_cut(sizes, 1024)
    assert all(sum(e - s for _, s, e in w) == 1024 for w in full) and sum(e - s for _, s, e in rest) == sum(sizes) % 1024
    for windows in (full + [rest], packing.plan_whole(sizes, 1024), packing.plan_rest(sizes)):
        parts = sorted(p for w in windows for p in w)
        for i, own in itertools.groupby(parts, key=lambda p: p[0]):
            own = list(own)
            assert own[0][1] == 0 and own[-1][2] == sizes[i] and all(a[2] == b[1] for a, b in itertools.pairwise(own))
        assert len({p[0] for p in parts}) == n
    assert all(0 < sum(e - s for _, s, e in w) <= 1024 for w in packing.plan_whole(sizes, 1024))
    lengths = [sum(e - s for _, s, e in w) for w in packing.plan_rest(sizes)]
    assert len(set(lengths)) == len(lengths) and all(x & (x - 1) == 0 for x in lengths)


def test_windows_rise_until_none_exceeds(monkeypatch):
    assert len(packing.plan_whole([600, 600, 600], 1024)) == 3
    counts, difference = [], packing.difference
    monkeypatch.setattr(packing, "difference", lambda sizes, k: counts.append(k) or difference(sizes, k))
    full, rest = packing.plan_cut([600] * 7, 1024)  # five windows would do, but hold two of them
    assert counts[0] == 5 and counts[-1] == 7 and counts == sorted(set(counts))
    assert len(full) == 4 and sum(e - s for _, s, e in rest) == 7 * 600 - 4 * 1024


def check(rows, docs):
    by_row = sorted(((r.doc_id is None, r.doc_id or 0), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = []
    for doc, text in docs:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, ids))
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    ids_of = dict(want)
    for key, start, length, crc, tokens in by_row:
        ids = ids_of[None if key[0] else key[1]]
        assert tokens == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    lengths = collections.Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
    short = collections.Counter(sequence >> 40 for sequence, n in lengths.items() if n < 1024)
    assert all(n <= 10 for n in short.values())  # a task's last ones


def test_query_over_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "short text"), (4, "long words and more " * 2000), (None, "no id"), (6, "x" * 1500)]
    df = spark.createDataFrame([(a, b, "other") for a, b in docs], "doc_id long, text string, start string").repartition(2)
    check(packing.pack(df, "doc_id", "text").collect(), docs)
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_rows_are_packed_as_often(spark):
    df = spark.createDataFrame([(1, "same words")] * 3, "doc_id long, text string")
    assert sum(r.length for r in packing.pack(df, "doc_id", "text").collect()) == 3 * (1 + len(LIBRARY.encode("same words").ids))


def test_query_on_a_table(spark):
    """The ids of the library, and nothing but a task's last tokens in short windows."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = QUERIES["op6_packing"](spark, "/root/testdata/sf0.001").collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    tasks = {r.sequence_id >> 40 for r in rows}
    short = sum(r.length for r in rows) - 1024 * len({r.sequence_id for r in rows})
    assert -short < len(tasks) * 10 * 1024


def test_many_tiny_documents_fill_windows(spark):
    docs = [(i, "a b") for i in range(3000)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id", "text", block=2).collect()
    check(rows, docs)


def test_encoder_holds_nothing_of_its_texts():
    """Its memory is its vocabulary, however many words come again."""
    encoder = packing._encoder(bpe.default_vocabulary())
    texts = [" ".join(f"{chr(97 + i % 26)}word{i * 7919 + k}" for k in range(20)) for i in range(3000)]
    encoder.encode_batch(texts[:10])
    tracemalloc.start()
    for _ in range(3):
        encoder.encode_batch(texts)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1_000_000


@pytest.mark.parametrize("part", [3, 1 << 20])
def test_ids_are_the_library_s_with_long_runs_and_in_parts(monkeypatch, part):
    monkeypatch.setattr(packing.parts, "__defaults__", (part,))
    encoder = packing._encoder(bpe.default_vocabulary())
    texts = ["", " ", "it's  we'LL \x1c x\x85y\u3000z", "a<|endoftext|> b", " " * 150_000 + "x", "a" + "\n" * 1_200_000 + "b c", "x" * 300_000, "a b  c " * 300]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
