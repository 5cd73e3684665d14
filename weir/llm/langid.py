"""Language identification of mixed-language text (operator 4).

Script ranges narrow the candidate languages of each word; a word's score for a language is its log-likelihood under
that language's letter n-grams and whole words, relative to the best candidate; Viterbi over a text's words, with a
penalty for each switch, labels spans. A document's language is the one whose spans hold most letters.

The model is fitted on a bounded sample of labelled documents (``DOCS_PER_LANG`` for each language, about): its size
doesn't depend on the table's. Prediction is one scan without a shuffle, over whole texts; texts of a slice go through
Viterbi side by side.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import release, slices

#: Labelled documents for each language that the classifier is fitted on, about.
DOCS_PER_LANG = 2000
BUCKETS = 1 << 16
SWITCH_PENALTY = 6.0
#: A word speaks against a language by so much at most.
FLOOR = -8.0
#: Of a language's letters, those of a script in which it is a candidate.
SCRIPT_SHARE = 0.02
#: Pieces between white space that are longer are cut into runs of letters, and these into parts.
LONGEST = 48
#: Words that a worker remembers before it starts anew, and characters of words that it scores together.
REMEMBERED, SCORED_CHARS = 300_000, 1 << 17
#: Texts from which on Viterbi takes its steps in all of them at once; fewer, the longest ones, go on one by one.
TOGETHER = 16
UNKNOWN = "und"

#: First and last code points of scripts' letters.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
_STARTS = [first for first, _, _ in SCRIPTS]
_LETTERS, _PIECE = regex.compile(r"[\p{L}\p{M}]+"), re.compile(r"\S+")


def script_of(letter: str) -> str:
    k = bisect.bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPTS[k][2] if k >= 0 and ord(letter) <= SCRIPTS[k][1] else "other"


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _scrambled(x: np.ndarray) -> np.ndarray:
    return (x * _P1) >> np.uint64(64 - BUCKETS.bit_length() + 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of lower-cased words' bigrams and trigrams, with the words' ends, and of whole words.

    Those of word ``i`` begin at ``starts[i]``; all words are taken together.
    """
    signs = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    one, two, three = signs[:-2], signs[1:-1], signs[2:]
    bigrams = signs[:-1] * _P2 + signs[1:] + np.uint64(1)
    trigrams = (one * _P2 + two) * _P2 + three + np.uint64(2)
    in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) + np.uint64(1 << 40)
    bucket = np.concatenate([_scrambled(bigrams[in_two]), _scrambled(trigrams[in_three]), _scrambled(whole)]).astype(np.int64)
    of = np.concatenate([owner[:-1][in_two], owner[:-2][in_three], np.arange(len(words))])
    order = np.argsort(of, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ends)))[:-1]]) if len(words) else np.zeros(0, np.int64)
    return bucket[order], starts


def _blocks(words: list[str], most: int = SCORED_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of words of so many characters, or one word: what is made of a block's letters is many times as large."""
    start, held = 0, 0
    for i, word in enumerate(words):
        if i > start and held + len(word) > most:
            yield start, i
            start, held = i, 0
        held += len(word)
    if start < len(words):
        yield start, len(words)


def pieces(text: str) -> list[str]:
    """What stands between white space; where that is long, its runs of letters, cut as in learning."""
    parts = text.split()
    if parts and max(map(len, parts)) > LONGEST:
        parts = [text[start:end] for start, end in places(text)]
    return parts


def places(text: str) -> list[tuple[int, int]]:
    """Starts and ends of ``pieces``."""
    out = []
    for m in _PIECE.finditer(text):
        if m.end() - m.start() <= LONGEST:
            out.append(m.span())
        else:
            for run in _LETTERS.finditer(text, *m.span()):
                out += _cuts(*run.span())
    return out


def _cuts(start: int, end: int) -> list[tuple[int, int]]:
    """A run of letters as it is, or if it is long, as parts of a third of that."""
    if end - start <= LONGEST:
        return [(start, end)]
    return [(i, min(end, i + LONGEST // 3)) for i in range(start, end, LONGEST // 3)]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: log-likelihoods, ``BUCKETS`` x languages
    weights: np.ndarray
    #: of each script the candidate languages as a mask
    scripts: dict[str, np.ndarray]


def is_held_out(doc_id: Column) -> Column:
    """Documents that the learner never sees; a null id counts as not held out, but isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, text_col: str, lang_col: str, key: Column, *, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Learn from rows with a text and a language; ``key`` decides, by its hash, which of them are in the sample."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("draw"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model((), np.zeros((BUCKETS, 0), np.float32), {})
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, docs_per_lang / n) * 1_000_000))) for lang, n in sorted(counts.items())])
    sample = rows.where(F.col("draw") < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for batch in slices(batches, "text"):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                low = text.lower()
                words.setdefault(lang, Counter()).update(low[a:b] for run in _LETTERS.finditer(low) for a, b in _cuts(*run.span()))
            for lang, counted in words.items():
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                names, all_times = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
                for first, end in _blocks(names):
                    bucket, starts = features(names[first:end])
                    times = all_times[first:end]
                    own += np.bincount(bucket, np.repeat(times, np.diff([*starts, len(bucket)])), BUCKETS).astype(np.int64)
                for word, n in counted.items():
                    key = (lang, script_of(word[0]))
                    scripts[key] = scripts.get(key, 0) + n * len(word)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "name": pa.array(map(str, at), pa.string()), "n": pa.array(own[at], pa.int64())})
        if scripts:
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in scripts], pa.string()), "name": pa.array([k[1] for k in scripts], pa.string()), "n": pa.array(scripts.values(), pa.int64())})

    # at most BUCKETS and a few scripts' rows for each language come to the driver
    table = sample.mapInArrow(count, "lang string, name string, n bigint").groupBy("lang", "name").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(set(table["lang"]))) if len(table) else tuple(sorted(counts))
    sums = np.full((BUCKETS, len(langs)), 0.5)
    letters: dict[str, np.ndarray] = {}
    for lang, name, n in table.itertuples(index=False):
        if name.isdigit():
            sums[int(name), langs.index(lang)] += n
        else:
            letters.setdefault(name, np.zeros(len(langs)))[langs.index(lang)] = n
    total = sum(letters.values(), np.zeros(len(langs))) + 1e-9
    weights = np.log(sums / sums.sum(0)).astype(np.float32)
    return Model(langs, weights, {s: n / total >= SCRIPT_SHARE for s, n in letters.items()})


class Scorer:
    """Words' scores, remembered; and Viterbi over many texts at once."""

    def __init__(self, model: Model):
        self.model = model
        self.scripts = sorted(model.scripts)
        #: candidates by script; the last row, for other scripts, has none
        self.masks = np.array([*(model.scripts[s] for s in self.scripts), np.zeros(len(model.langs), bool)])
        self.places = {s: i for i, s in enumerate(self.scripts)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # row of a piece; 0 for pieces without letters
        self.scores = np.zeros((1024, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.used = 1

    def add(self, pieces: list[str]) -> None:
        """Score new pieces, many together: the sum of their runs of letters, each against its best candidate."""
        known, runs, of, letters = self.known, [], [], []
        first = self.used
        for piece in pieces:
            n = sum(map(str.isalpha, piece))
            if not n:
                known[piece] = 0
                continue
            known[piece] = first + len(letters)
            for run in _LETTERS.findall(piece.lower()):
                runs.append(run)
                of.append(len(letters))
            letters.append(n)
        need = first + len(letters)
        if need > len(self.letters):
            room = max(need, 2 * len(self.letters)) - len(self.letters)
            self.scores = np.concatenate([self.scores, np.zeros((room, self.scores.shape[1]), np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(room, np.int64)])
        self.letters[first:need] = letters
        self.used = need
        total = np.zeros((len(letters), self.scores.shape[1]), np.float32)
        for start, end in _blocks(runs):
            bucket, starts = features(runs[start:end])
            score = np.add.reduceat(self.model.weights[bucket], starts, axis=0) / 2
            mask = self.masks[[self.places.get(script_of(run[0]), -1) for run in runs[start:end]]]
            some = mask.any(1)  # where no learned language is written so, a run speaks for none
            best = np.where(mask, score, -np.inf).max(1, where=some[:, None], initial=-np.inf)
            own = np.where(mask, np.maximum(score - np.where(some, best, 0)[:, None], FLOOR), FLOOR)
            own[~some] = 0
            np.add.at(total, np.array(of[start:end]), own)
        self.scores[first:need] = np.maximum(total, FLOOR)

    def label(self, texts: list[list[str]], penalty: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each text's pieces the language number (-1 without letters) and the letters."""
        if len(self.known) > REMEMBERED:
            self.clear()
        get = self.known.get
        found = [list(map(get, parts)) for parts in texts]
        new: dict[str, None] = {}
        for parts, rows in zip(texts, found, strict=True):
            if None in rows:
                new.update(dict.fromkeys(p for p, row in zip(parts, rows, strict=True) if row is None))
        if new:
            self.add(list(new))
        ids = [np.array([get(p) if row is None else row for p, row in zip(parts, rows, strict=True)] if None in rows else rows, np.int64) for parts, rows in zip(texts, found, strict=True)]
        own = [x[x > 0] for x in ids]
        labels = viterbi([self.scores[x] for x in own], penalty, self.scores.shape[1])
        out = []
        for x, labelled in zip(ids, labels, strict=True):
            full = np.full(len(x), -1)
            full[x > 0] = labelled
            out.append(full)
        return out, [self.letters[x] for x in ids]


def viterbi(scores: list[np.ndarray], penalty: float, n: int) -> list[np.ndarray]:
    """The best labels of each text, staying at no cost and switching at ``penalty``; ties stay, then go to the first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return [np.zeros(0, np.int64) for _ in scores]
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t come first
    flat = np.concatenate([scores[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    value = flat[starts[: active[0]]].astype(np.float64)
    # of each word whether a label was reached by staying, and the label to switch from
    stays, bests = np.empty(flat.shape, bool), np.empty(len(flat), np.int32)
    rows = np.arange(active[0])
    cut = max(1, int(np.searchsorted(-active, -TOGETHER, side="right")))
    longest = range(active[cut] if cut < steps else 0)
    for t in range(1, cut):
        a = active[t]
        now, at = value[:a], starts[:a] + t
        best = now.argmax(1)
        switched = (now[rows[:a], best] - penalty)[:, None]
        stays[at], bests[at] = now >= switched, best
        np.maximum(now, switched, out=now)
        now += flat[at]
    for k in longest:
        value[k] = _forth(flat, stays, bests, starts[k] + cut, starts[k] + sizes[k], value[k].tolist(), penalty)
    labels = np.empty(len(flat), np.int64)
    current = value.argmax(1)
    for k in longest:
        current[k] = _back(labels, stays, bests, starts[k] + cut, starts[k] + sizes[k], int(current[k]))
    for t in range(cut - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = current[:a]
        if t:
            current[:a] = np.where(stays[at, current[:a]], current[:a], bests[at])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for k, i in enumerate(order):
        out[i] = labels[starts[k] : starts[k] + sizes[k]]
    return out


def _forth(flat: np.ndarray, stays: np.ndarray, bests: np.ndarray, start: int, end: int, value: list[float], penalty: float) -> list[float]:
    """Viterbi's steps in the words ``start`` to ``end`` of one text, in blocks of bounded size."""
    for low in range(start, end, 4096):
        stayed, chosen = [], []
        for row in flat[low : min(end, low + 4096)].tolist():
            most = max(value)
            chosen.append(value.index(most))
            switched = most - penalty
            stayed.append([x >= switched for x in value])
            value = [(x if x >= switched else switched) + y for x, y in zip(value, row, strict=True)]
        stays[low : low + len(chosen)], bests[low : low + len(chosen)] = stayed, chosen
    return value


def _back(labels: np.ndarray, stays: np.ndarray, bests: np.ndarray, start: int, end: int, current: int) -> int:
    """Label the words ``end`` to ``start`` of one text, that ends in ``current``; the label before them."""
    for low in reversed(range(start, end, 4096)):
        high = min(end, low + 4096)
        own = []
        for stayed, best in zip(reversed(stays[low:high].tolist()), reversed(bests[low:high].tolist()), strict=True):
            own.append(current)
            if not stayed[current]:
                current = best
        labels[low:high] = own[::-1]
    return current


def predict(df: DataFrame, text_col: str, model: Model, *, penalty: float = SWITCH_PENALTY, pred: str = "lang_pred", score: str = "score", spans: str | None = None) -> DataFrame:
    """``df`` with a language, the share of letters in its spans and, under the name ``spans``, the spans themselves.

    A null text, one without letters, and any text if nothing was learned get ``und`` and 0. Spans are
    ``struct<start, end, lang>`` in code points, end exclusive, from letter to letter; asking for them changes no
    prediction. Columns of the same names (in any case) are replaced; rows are neither lost nor compared, so ids may
    be null or repeated.
    """
    spark = df.sparkSession
    made = {c.lower() for c in (pred, score, spans) if c}
    kept = [c for c in df.columns if c.lower() not in made]
    shipped = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in kept]).schema)
    schema = f"{fields}, `{pred}` string, `{score}` double" + (f", `{spans}` array<struct<start:bigint,end:bigint,lang:string>>" if spans else "")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(shipped.value)
        langs = scorer.model.langs
        for batch in slices(batches, at, 2048):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            preds, scores, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if langs:
                labels, letters = scorer.label([pieces(t) for t in texts], penalty)
                for i, (own, weight) in enumerate(zip(labels, letters, strict=True)):
                    if total := int(weight.sum()):
                        sums = np.bincount(own[own >= 0], weights=weight[own >= 0], minlength=len(langs))
                        best = int(sums.argmax())
                        preds[i], scores[i] = langs[best], float(sums[best] / total)
                        if spans:
                            found[i] = _merged(texts[i], own, langs)
            columns = [*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            names = [*kept, pred, score]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def _merged(text: str, labels: np.ndarray, langs: tuple[str, ...]) -> list[dict]:
    """Neighbouring pieces of one language as a span."""
    out: list[dict] = []
    for (start, end), k in zip(places(text), labels.tolist(), strict=True):
        if k >= 0:
            runs = [m.span() for m in _LETTERS.finditer(text, start, end)]
            if out and out[-1]["lang"] == langs[k]:
                out[-1]["end"] = runs[-1][1]
            else:
                out.append({"start": runs[0][0], "end": runs[-1][1], "lang": langs[k]})
    return out


def identify(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from labelled documents that aren't held out, predicted for all."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))), "text", "lang", F.col("doc_id"))
    out = predict(rows.select("doc_id", "text"), "text", model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
