"""Operator 4: Viterbi against brute force, held-out accuracy, spans and edge rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from weir.llm import langid
from weir.llm.queries import QUERIES
from weir.llm.shared import table


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (0, 1, 5, 7, 3, 7)]
    for x, got in zip(texts, langid.viterbi(texts, 1.5, 3), strict=True):
        worth = lambda path: sum(x[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max((worth(p) for p in itertools.product(range(3), repeat=len(x))), default=0)
        assert abs(worth(got) - best) < 1e-5


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    out = QUERIES["op4_langid"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right / n > 0.97


def fitted(spark):
    rng = random.Random(1)
    words = {"xx": ["kata", "mako", "tiku", "nara"], "yy": ["shrub", "brisk", "stolz", "glint"], "zz": ["мир", "день", "слово", "город"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 8)]
    return langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"), "text", "lang", F.col("id"))


def test_spans_of_mixed_text_and_edge_rows(spark):
    model = fitted(spark)
    first, second, third = "kata mako tiku nara kata", "shrub brisk stolz glint brisk", "мир день слово город"
    text = f"{first}. {second}! {third}"
    rows = [(1, text), (1, text), (None, None), (3, ""), (4, "12 34 !!"), (5, "漢字"), (6, "kata " * 30_000), (7, "shrub" * 500)]
    df = spark.createDataFrame([(i, t, "taken") for i, t in rows], "doc_id long, text string, score string")
    out = langid.predict(df, "text", model, spans="spans").collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    got = [(text[s.start : s.end], s.lang) for s in by[1].spans]
    assert got == [(first, "xx"), (second, "yy"), (third, "zz")]
    assert [by[i].lang_pred for i in (None, 3, 4)] == ["und"] * 3 and by[4].score == 0
    assert by[5].lang_pred in model.langs and by[6].lang_pred == "xx" and by[6].score == 1.0 and by[7].lang_pred == "yy"
    plain = {r.doc_id: r.lang_pred for r in langid.predict(df, "text", model).collect()}
    assert plain == {r.doc_id: r.lang_pred for r in out}


def test_scripts_narrow_candidates(spark):
    model = fitted(spark)
    assert model.scripts["Cyrillic"].tolist() == [False, False, True] and model.scripts["Latin"].tolist() == [True, True, False]


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df, "doc_id", "text", "lang").collect()] == ["und"]
    assert langid.identify(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_all_of_a_long_run_is_learned(spark):
    """A language without spaces whose letters of one kind stand behind the first ``LONGEST`` only."""
    rows = [(i, "กขคง" * 12 + "จฉชซ" * 12, "th") for i in range(5)] + [(9, "งงงง", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"), "text", "lang", F.col("id"))
    bucket, _ = langid.features(["จฉชซจฉชซจฉชซจฉชซ"])
    th, xx = (model.weights[:, model.langs.index(lang)] for lang in ("th", "xx"))
    assert (th[bucket] > th.min()).mean() > 0.9 and (xx[bucket] == xx.min()).all()


def plain_best(scores, penalty):
    """Viterbi as the textbook has it, one word after the other."""
    value, back = list(map(float, scores[0])), []
    for row in scores[1:]:
        most = max(value)
        best, switched = value.index(most), most - penalty
        back.append([k if x >= switched else best for k, x in enumerate(value)])
        value = [max(x, switched) + float(y) for x, y in zip(value, row, strict=True)]
    label = value.index(max(value))
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def test_long_texts_are_labelled_like_short_ones():
    """Few long texts go on one by one, in blocks; many go together."""
    rng = np.random.default_rng(5)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (9000, 4096, 1, 0, 7, 5000, *range(2, 40))]
    for x, got in zip(texts, langid.viterbi(texts, 1.0, 3), strict=True):
        assert got.tolist() == (plain_best(x, 1.0) if len(x) else [])


def test_query_matches_a_plain_viterbi(spark):
    """Word by word over the same model: scores from the model's weights, labels one after the other."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))), "text", "lang", F.col("doc_id"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op4_langid"](spark, "/root/testdata/sf0.001").collect():
        rows, letters = [], []
        for piece in langid.pieces(texts[r.doc_id]):
            n = sum(map(str.isalpha, piece))
            if not n:
                continue
            total = np.zeros(len(model.langs), np.float32)
            for run in langid._LETTERS.findall(piece.lower()):
                mask = model.scripts.get(langid.script_of(run[0]))
                if mask is not None and mask.any():
                    score = model.weights[langid.features([run])[0]].sum(0) / 2
                    total += np.where(mask, np.maximum(score - score[mask].max(), langid.FLOOR), langid.FLOOR)
            rows.append(np.maximum(total, langid.FLOOR))
            letters.append(n)
        if not rows:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = np.bincount(plain_best(rows, langid.SWITCH_PENALTY), weights=letters, minlength=len(model.langs))
        assert r.lang_pred == model.langs[int(sums.argmax())] and abs(r.score - sums.max() / sum(letters)) < 1e-3


def test_spans_change_no_prediction(spark):
    """Long runs, mixed scripts and signs: the same label and share, whether spans are asked for or not."""
    model = fitted(spark)
    texts = ["shrub-kata" * 30, "kata" * 60 + " мир", "kata,shrub;brisk/stolz" * 9, "漢字kata" * 40, "a\x1cb\x85c kata", "день" * 200 + " kata"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, "text", model).collect()}
    for r in langid.predict(df, "text", model, spans="spans").collect():
        assert (r.lang_pred, r.score) == plain[r.doc_id]
        assert all(texts[r.doc_id][s.start].isalpha() and s.start < s.end <= len(texts[r.doc_id]) for s in r.spans)
    assert "".join(langid.pieces("字" * 200)) == "字" * 200 and langid.pieces("x" * 17 + "/" * 40) == ["x" * 17]


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from weir.llm.shared import slices

    texts = ["a" * 10, None, "b" * 500, "c" * 90, "", "d" * 20]
    batch = pa.RecordBatch.from_pydict({"n": list(range(6)), "text": texts})
    parts = [s.column("text").to_pylist() for s in slices([batch], "text", 3, 100)]
    assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 100 and len(p) <= 3 for p in parts)
    assert list(slices([batch.slice(0, 0)], "text")) == []
