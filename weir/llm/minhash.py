"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping (operator 3).

A document is its set of five-word shingles. SuperMinHash gives each element a random permutation of the slots with
ranks 0, 1, 2, ... plus a random fraction; a slot holds the least value that it meets. All elements of a document take
their step of rank ``j`` together, and the document stops as soon as every slot holds less than the next rank: most
documents stop after one step. Slots agree with the probability of the sets' similarity.

1. Documents with equal sets are one class; what follows is about classes.
2. Band values meet in buckets. Each class is first compared with one bucket leader, the one it shares most buckets
   with; links are confirmed on full sets. That joins nearly all groups with one pair for each class.
3. Buckets that still hold more than one component are worked off: in small ones every pair of two components, in
   large ones the pairs that an exact prefix filter leaves (two sets of similarity 0.75 share a shingle among the
   rarest quarter of each). Pairs whose signatures agree in less than half of the slots aren't compared.

Sets, signatures and links stay in the shared folder; nothing of them is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.components import components
from weir.llm.shared import release, slices, small_or_not, written

WORDS = 5
SIMILAR = 75  # percent
BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
#: Classes in a bucket up to which its pairs of two components are all compared.
SMALL_BUCKET = 32
#: Share of agreeing slots below which a pair isn't compared: 8 standard deviations under the threshold.
AGREEING = 0.5
REMEMBERED = 400_000

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def shingle_sets(texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles: words between ASCII white space, A-Z lower-cased."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((h for w in words for h in map(hashes.__getitem__, w)), _U, sum(sizes))
    rolled = np.zeros(max(0, len(flat) - WORDS + 1), _U)
    for k in range(WORDS):
        rolled = rolled * _BASE + flat[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for own, size in zip(words, sizes, strict=True):
        if size >= WORDS:
            out.append(np.unique(rolled[at : at + size - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=1)] if size else [], _U))
        at += size
    return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of non-empty sets of 64-bit hashes, ``len(sets)`` x ``slots``."""
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), slots), np.inf)
    flat = best.reshape(-1)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    places = None  # of each element its permutation so far; made for elements that take a second step
    for rank in range(slots):
        drawn = mix(elements + _U((0x9E3779B97F4A7C15 * (2 * rank + 1)) & (2**64 - 1)))
        fraction = (drawn >> _U(32)).astype(np.float64) / 2.0**32
        pick = rank + ((drawn & _U(0xFFFFFFFF)) % _U(slots - rank)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            if rank == 1:
                places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
                each = np.arange(len(elements))
                places[each, first], places[:, 0] = 0, first
            each = np.arange(len(elements))
            slot = places[each, pick].astype(np.int64)
            places[each, pick] = places[:, rank]
        np.minimum.at(flat, owner * slots + slot, rank + fraction)
        going = best.max(1) >= rank + 1
        stay = going[owner]
        if not stay.any():
            break
        if rank == 0:
            first = pick[stay]
        elif not stay.all():
            places = places[stay]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
    return best


def band_values(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band, that names the band too."""
    bits = np.ascontiguousarray(signatures).view(_U).reshape(len(signatures), -1, ROWS)
    out = np.arange(bits.shape[1], dtype=_U)[None, :] * _ODD + _U(7)
    for k in range(ROWS):
        out = mix(out * _BASE + bits[:, :, k])
    return out


def _superminhash_in_blocks(sets: list[np.ndarray], most: int = 50_000) -> np.ndarray:
    """In blocks of so many elements, or one set."""
    out, block, held = [], [], 0
    for s in sets:
        if block and held + len(s) > most:
            out.append(superminhash(block))
            block, held = [], 0
        block.append(s)
        held += len(s)
    return np.concatenate([*out, superminhash(block)]) if block else np.zeros((0, SLOTS))


def sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, node, bands, slots`` of ``doc_id, text``: node is the hash of the set, null if empty.

    ``slots`` holds a byte of each slot of the signature.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), hashes)
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures = _superminhash_in_blocks([sets[i] for i in full])
            bands = band_values(signatures).view(np.int64)
            small = (mix(np.ascontiguousarray(signatures).view(_U)) & _U(255)).astype(np.uint8)
            nodes, values, bytes_ = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(full):
                nodes[i], values[i], bytes_[i] = node_of(sets[i]), bands[k], small[k].tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array(nodes, pa.int64()), "bands": pa.array(values, pa.list_(pa.int64())), "slots": pa.array(bytes_, pa.binary()),
            })

    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, n bigint, node bigint, bands array<bigint>, slots binary")


def node_of(shingles: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), np.int64)[0])


def full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the texts whose hash ``wanted`` has; of copies one, chosen before the shuffle."""
    keyed = rows.select(F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    texts = keyed.join(small_or_not(wanted), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = WordHashes()
        for batch in slices(batches, "text", 256):
            sets = [s for s in shingle_sets(batch.column("text").to_pylist(), hashes) if len(s)]
            yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(s) for s in sets], pa.int64()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return texts.select("text").mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``a, b`` whose full sets are similar enough."""
    n = lambda c: F.size(c).cast("long")
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = n(F.array_intersect("sa", "sb"))
    return both.where(100 * F.least(n("sa"), n("sb")) >= SIMILAR * F.greatest(n("sa"), n("sb"))).where(100 * shared >= SIMILAR * (n("sa") + n("sb") - shared)).select("a", "b")


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``a, b`` of fitting sizes whose signatures agree in enough slots."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("slots").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("slots").alias("xb"))
    both = pairs.distinct().join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("xa", "xb"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= AGREEING))

    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def links(rows: DataFrame, sketch: DataFrame) -> DataFrame | None:
    """Links of classes, ``a, b``, that join every component that the bands' candidates make; None if no band is shared."""
    # copies meet before they move, so that neither a class nor its buckets are as large as their number
    first = [F.first(c).alias(c) for c in ("n", "slots", "bands")]
    classes = written(sketch.where("node IS NOT NULL").groupBy("node").agg(F.min("text_hash").alias("text_hash"), *first), "classes")
    bucketed = classes.select("node", F.explode("bands").alias("bucket"))
    leads = bucketed.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("bucket", "a")
    led = bucketed.join(leads, "bucket").where("node <> a").groupBy("a", F.col("node").alias("b")).count()
    led = written(led, "leaders")
    if led.isEmpty():
        return None
    best = led.groupBy("b").agg(F.max(F.struct("count", -F.col("a"), "a")).alias("m"))
    nearest = best.select(F.col("m.a").alias("a"), "b")
    shared = written(bucketed.join(leads.select("bucket"), "bucket", "left_semi").distinct(), "buckets")
    members = shared.select("node").distinct()
    wanted = written(classes.drop("bands").join(members, "node", "left_semi"), "nodes")
    sets = written(full_sets(rows, wanted.select("text_hash")), "sets")
    found = written(confirmed(nearest, sets), "links")
    second = screened(_apart(led.select("a", "b"), components(found)), wanted)
    found = written(found.unionByName(confirmed(written(second, "pairs"), sets)), "links")
    comps = components(found)
    own = shared.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = own.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    left = written(own.join(sizes.select("bucket", "size"), "bucket"), "residue")
    small = left.where(F.col("size") <= SMALL_BUCKET)
    pairs = small.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca")).join(small.select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb")), "bucket")
    pairs = pairs.where("ca < cb").select("a", "b")
    large = written(left.where(F.col("size") > SMALL_BUCKET).select("node", "comp").distinct(), "large")
    if not large.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(large, sets))
    return found.unionByName(confirmed(written(screened(pairs, wanted), "pairs"), sets))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Those of ``a, b`` that aren't in one component yet."""
    of = lambda c: small_or_not(comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of two components that share one of the shingles that similar sets must share, rarest first: exact.

    Only shingles of two components at least can be shared by such a pair; a set's others come first in its order.
    Of sets of sizes m and n that overlap in at least o shingles, the first m - o + 1 and n - o + 1 share one.
    """
    one = sets.join(nodes, "node").select("node", "comp", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    counts = one.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    common = one.join(counts.select("shingle", "docs"), "shingle")
    per = Window.partitionBy("node")
    ranked = common.withColumn("rank", F.row_number().over(per.orderBy("docs", "shingle")) + F.col("n") - F.count("*").over(per))
    # a partner has 0.75 n shingles at least, and then they overlap in as many
    kept = written(ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1).select("shingle", "node", "comp", "n", "rank"), "prefixes")
    side = lambda x: kept.select("shingle", F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("rank").alias(f"r{x}"))
    overlap = F.ceil((F.col("na") + F.col("nb")) * SIMILAR / (100 + SIMILAR))
    fits = (F.col("ca") < F.col("cb")) & (F.col("ra") <= F.col("na") - overlap + 1) & (F.col("rb") <= F.col("nb") - overlap + 1)
    return side("a").join(side("b"), "shingle").where(fits & (100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))).select("a", "b").distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """A written table of a row for each of ``doc_id, text``: ``doc_id, text_hash, n_shingles, comp, component_id, kept``."""
    sketch = written(sketches(rows), "sketches")
    found = links(rows, sketch)
    slim = sketch.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node")
    if found is None:
        comped = slim.withColumn("comp", F.col("node"))
    else:
        comps = small_or_not(components(written(found, "links")))
        comped = slim.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    comped = written(comped.drop("node"), "comps")
    least = comped.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    least = small_or_not(written(least.where("size > 1"), "least"))
    joined = comped.join(least, "comp", "left")
    component = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = joined.select("doc_id", "text_hash", "n_shingles", "comp", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def group(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    A document without words (or with a null text) has no shingles and is linked with nothing. Rows of one id are
    each grouped by their own text. A null id never is a component's smallest; a row without an id is kept only if its
    component has none. Other columns are left behind; one row out for each row in.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(rows).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row of each group, with all its columns, whatever their names.

    It is the row of the smallest id; of several with that id, one with the smallest hash of its text. Documents
    without words all stay, but equal rows of one id as one.
    """
    names = df.columns
    # the columns' own names could clash with those that are joined to them
    own = df.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    found = written(_grouped(own.select(doc.alias("doc_id"), text.alias("text"))), "grouped")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash")).distinct()
    several = found.where("kept").groupBy("doc_id", "comp").agg(F.min("text_hash").alias("chosen"), F.count("*").alias("n")).where("n > 1")
    several = several.select(F.col("doc_id").alias("doc"), F.col("comp").alias("of"), "chosen")
    several = found.where("kept").join(several, F.col("doc_id").eqNullSafe(F.col("doc")) & F.col("comp").eqNullSafe(F.col("of")))
    several = written(several.select("doc", F.col("text_hash").alias("hash"), "chosen").distinct(), "several")
    same = doc.eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("hash"))
    left = own.join(small_or_not(written(gone, "gone")), same, "left_anti")
    if not several.isEmpty():
        alone = left.join(small_or_not(several), same, "left_anti")
        chosen = left.join(small_or_not(several), same).where(F.col("hash") == F.col("chosen")).dropDuplicates(["doc", "hash"])
        left = alone.unionByName(chosen.drop("doc", "hash", "chosen"))
    return left.toDF(*names)


def oracle() -> str:
    """DuckDB SQL of ``group`` over documents with different ids."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))) END AS shingles FROM w),
e AS MATERIALIZED (SELECT doc_id, hash(shingle) AS h, shingle, n FROM (SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM s)),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.shingle = b.shingle
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {SIMILAR} * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared WHERE 100 * common >= {SIMILAR} * (m + n - common)),
reach AS (SELECT x AS doc_id, y AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
least_of AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(least(least, s.doc_id), s.doc_id) AS component_id, s.doc_id = coalesce(least(least, s.doc_id), s.doc_id) AS kept
FROM s LEFT JOIN least_of USING (doc_id)"""
