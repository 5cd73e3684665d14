"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing (operator 6).

Every document's ids (with an end-of-document id) give full windows of their own and a tail. Tails are taken in
blocks, in the order of the scan; a block's tails are split into ``k`` windows by multiway differencing: the two
partial partitions with the largest spread are merged with opposing imbalances, the fullest window of one with the
emptiest of the other, until one is left. Its windows are nearly equal. ``k`` begins with as many windows as the
tokens need; whenever one exceeds the capacity the window count rises and the block is split anew.

Without cutting that is all, and windows may be short of the capacity. With cutting, the fullest windows, as many as
the tokens fill, are filled up from the emptiest ones, which so dissolve; what is left, less than a window, goes into
the task's next block. Only a task's last tokens make shorter windows, whose lengths are powers of two.

No row leaves its task: the plan is one scan without a shuffle, and no block holds more than ``block`` tails and a
window's worth of pieces.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.bpe import PRETOKEN_PATTERN, TrieBpe, default_vocabulary
from weir.llm.shared import held, slices

END_ID = 0
CAPACITY = 1024
#: Tails that are split together.
BLOCK = 128
#: Longer texts are encoded part by part.
PART_CHARS = 1 << 20
#: Texts with as long a run of white space are cut into pre-tokens here.
WHITE_RUN = 100_000
_WHITE = re.compile(r"\s{64,}").finditer
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)").search


class TextBpe(TrieBpe):
    """The same ids from the ``tiktoken`` library, where ids follow the order of merges.

    It cuts texts into pre-tokens and encodes them in one go and remembers nothing of them, so a worker holds its
    vocabulary only. Its pattern matcher can't take runs of about a million white spaces; texts with long runs are cut here.
    """

    def __init__(self, path: str):
        super().__init__(path)
        ranked = sorted((i for i in self.ids.values() if self._rank[i] >= 0), key=self._rank.__getitem__)
        self._core = None
        if ranked == sorted(ranked) and len(self.vocab) == len(self.ids):
            core = tiktoken.Encoding("vocabulary", pat_str=PRETOKEN_PATTERN, mergeable_ranks=self.ids, special_tokens={})._core_bpe
            # the trie isn't used: only what cuts texts stays
            self.__dict__ = {"_core": core, "specials": self.specials, "_special": self._special, "_pretokens": self._pretokens}

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        if self._core is None:
            return super()._encode_group(texts)
        return [b"".join(map(self._encode_part, parts(text))) for text in texts]

    def _encode_part(self, text: str) -> bytes:
        if len(text) >= WHITE_RUN and any(m.end() - m.start() >= WHITE_RUN for m in _WHITE(text)):
            ids = itertools.chain.from_iterable(self._core.encode_single_piece(word.encode()) for word in self._pretokens(text))
        else:
            ids = self._core.encode_ordinary(text)
        return array("I", ids).tobytes()


def parts(text: str, chars: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of ``chars`` characters and up to the next single space between others, where a pre-token begins."""
    start = 0
    while len(text) - start > chars and (cut := _SINGLE_SPACE(text, start + chars)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _encoder(path: str) -> TrieBpe:
    return held(("packing", path), lambda: TextBpe(path))


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows by multiway differencing; ties go to the smaller index."""
    if k <= 1:
        return [list(range(len(sizes)))] if k == 1 else []
    first = itemgetter(0)
    # a partial partition: its non-empty windows as (sum above the emptiest, members), fullest first
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - k)
        keep_a, keep_b = len(a) - shared, len(b) - shared
        joined = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[keep_a:], reversed(b[keep_b:]), strict=True)]
        merged = sorted(a[:keep_a] + b[:keep_b] + joined, key=first, reverse=True)
        if len(merged) == k and merged[-1][0]:
            least = merged[-1][0]
            merged = [(x - least, p) for x, p in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    windows = []
    for _, node in heap[0][2] if heap else []:
        members, stack = [], [node]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                members.append(node)
        windows.append(sorted(members))
    return windows + [[] for _ in range(k - len(windows))]


def risen(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of whole items, by index: the count rises until no window exceeds ``capacity``."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = difference(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not over:
            return [w for w in windows if w]
        k = min(len(sizes), k + max(1, over // capacity))


def plan_whole(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of whole items (item, 0, its size)."""
    return [[(i, 0, sizes[i]) for i in w] for w in risen(sizes, capacity)]


def _filled(window: list[tuple[int, int, int]], room: int, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``window`` with ``room`` tokens more from the end of ``pieces``, the last one cut."""
    while room:
        i, start, end = pieces.pop()
        cut = min(end, start + room)
        window.append((i, start, cut))
        if cut < end:
            pieces.append((i, cut, end))
        room -= cut - start
    return window


def plan_cut(sizes: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of pieces (item, start, end), and the pieces that are left, less than a window in all."""
    load = lambda w: sum(sizes[i] for i in w)
    windows = sorted(risen(sizes, capacity), key=load, reverse=True)
    whole = sum(sizes) // capacity
    pieces = [(i, 0, sizes[i]) for w in windows[whole:] for i in reversed(w)]
    full = [_filled([(i, 0, sizes[i]) for i in w], capacity - load(w), pieces) for w in windows[:whole]]
    return full, pieces[::-1]


def plan_rest(sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces whose lengths are powers of two."""
    pieces = [(i, 0, size) for i, size in enumerate(sizes) if size][::-1]
    total = sum(sizes)
    return [_filled([], 1 << bit, pieces) for bit in reversed(range(total.bit_length())) if total >> bit & 1]


def pack(df: DataFrame, id_col: str, text_col: str, *, capacity: int = CAPACITY, cut: bool = True, block: int = BLOCK, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in windows of at most ``capacity`` ids.

    A document is its text's ids (null or empty text: none) and id 0. Returns one row for each piece: ``doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``keep_ids``, ``ids`` (little-endian
    unsigned 32-bit). Each row of the input is packed by itself, so repeated rows are packed as often, and a null
    document id passes through; other columns are left behind; an empty table gives no rows. Sequence ids are
    unique and hold the number of the scan's partition; the same files and session settings give the same ids.
    Of each task all windows are full but for a few last ones, whose lengths are powers of two. With ``cut=False``
    tails stay whole and windows may be short of the capacity.
    """
    path = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * keep_ids
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tails: list[tuple] = []

        def piece(doc, start, ids, tokens, sequence, offset):
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, ids if keep_ids else None))

        def place(windows):
            nonlocal sequence
            for window in windows:
                offset = 0
                for i, s, e in window:
                    doc, start, ids, tokens = tails[i]
                    piece(doc, start + s, ids[4 * s : 4 * e], tokens, sequence, offset)
                    offset += e - s
                sequence += 1

        def flush(last=False):
            sizes = [len(t[2]) // 4 for t in tails]
            windows, rest = plan_cut(sizes, capacity) if cut else (plan_whole(sizes, capacity), [])
            place(windows)
            tails[:] = [(tails[i][0], tails[i][1] + s, tails[i][2][4 * s : 4 * e], tails[i][3]) for i, s, e in rest]
            if last and tails:
                place(plan_rest([len(t[2]) // 4 for t in tails]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            made = {"doc_id": pa.array(columns[0], doc_type)}
            for name, values in zip(("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), columns[1:7], strict=True):
                made[name] = pa.array(values, pa.int64())
            if keep_ids:
                made["ids"] = pa.array(columns[7], pa.binary())
            rows.clear()
            return pa.RecordBatch.from_pydict(made)

        doc_type, new, held = None, 0, 0
        for batch in slices(batches, "text"):
            doc_type = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode_batch(batch.column("text").to_pylist()), strict=True):
                ids += end
                tokens = len(ids) // 4
                whole = tokens - tokens % capacity
                for start in range(0, whole, capacity):
                    piece(doc, start, ids[4 * start : 4 * (start + capacity)], tokens, sequence, 0)
                    sequence += 1
                if whole < tokens:
                    tails.append((doc, whole, ids[4 * whole :], tokens))
                    new, held = new + 1, held + tokens - whole
                if new >= block and held >= capacity:
                    flush()
                    new, held = 0, sum(len(t[2]) // 4 for t in tails)
            yield out()
        if doc_type is not None:
            flush(last=True)
            yield out()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
