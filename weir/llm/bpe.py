"""Byte-level BPE by prefix-sharing trie traversal (operator 9).

A BPE encoding is determined by its adjacent pairs: a token sequence is *the* encoding of its bytes exactly if
every two neighbours encode to themselves. So each prefix of a word has one possible last token: a token ``t``
that ends the prefix and is compatible with the last token of the prefix without ``t``. Distinct words go into a
trie (kept as the sorted list of words, whose order is the trie's depth-first order); the traversal holds one
last-token state for each byte on the current path, so a prefix that many words share is encoded once.

Texts are cut at single spaces between two non-spaces, where a pre-token always begins; pieces and their ids are
remembered by each worker up to a fixed number of bytes, after which it starts anew. Nothing is dropped.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import held, slices

#: Fixed values of the byte-level pre-tokenizer: contractions, letters, numbers, other signs, white space.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of remembered pieces for each Python worker.
MEMORY_BYTES = 128 << 20
#: Longer pieces are encoded without being remembered.
LONGEST_REMEMBERED = 64
#: Texts go to the encoder in groups of about so many characters.
GROUP_CHARS = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by rule."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """``ValueError`` for a file whose ids this encoder wouldn't give."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [f"{name} {spec[name]['type']}" for name in ("normalizer",) if spec.get(name)]
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append(f"pre-tokenizer {before}")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    wrong += [f"model's {name}" for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    wrong += [f"token {t['content']!r}" for t in spec["added_tokens"] if any(t.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model.get("type", "BPE") != "BPE" or wrong:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(wrong) or model['type']}")


class TrieBpe:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library (byte-level BPE, no dropout)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _check(spec)
        model, alphabet = spec["model"], byte_alphabet()
        raw = {token: bytes(alphabet[c] for c in token) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * size
        for piece, i in self.ids.items():
            self.token_bytes[i] = piece
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.specials.items():
            self.token_bytes[i] = content.encode()
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self._pretokens = regex.compile(PRETOKEN_PATTERN).findall
        #: Of each token its parts and the rank of the merge that made it; -1 for single bytes.
        self._parts: list[tuple[int, int] | None] = [None] * size
        self._rank = [-1] * size
        self._merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = model["vocab"][a], model["vocab"][b], self.ids[raw[a] + raw[b]]
            self._merge.setdefault((left, right), rank)
            if self._rank[whole] < 0 and len(self.token_bytes[whole]) > 1:
                self._rank[whole], self._parts[whole] = rank, (left, right)
        #: Tokens that encode to themselves; others never occur in an encoding.
        self.vocab: dict[bytes, int] = {}
        for piece, i in sorted(self.ids.items(), key=lambda x: self._rank[x[1]]):
            parts = self._parts[i]
            if len(piece) == 1 or parts and self._separate(*parts, self._rank[i]):
                self.vocab[piece] = i
        self._longest = max(map(len, self.vocab))
        #: Lengths of tokens by their last bytes, four at most, and what ``_ends`` has found so far.
        self._by_end: dict[bytes, set[int]] = {}
        for piece in self.vocab:
            self._by_end.setdefault(piece[-4:], set()).add(len(piece))
        self._lengths: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes | bool] = {}  # False: a piece of a run of white space
        self._held = 0
        self._slots = (1 << 23) - 1
        self._met = bytearray(self._slots + 1)

    def _separate(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether no merge before rank ``limit`` crosses the boundary of ``a`` and ``b``.

        Undoes, latest first, the merges that made the tokens at the boundary. At equal rank the left one of two
        overlapping merges happens first.
        """
        rank, parts = self._rank, self._parts
        while True:
            crossing = self._merge.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 1, parts[b][0]

    def _again(self, piece: str) -> bool:
        """Whether a short piece was met in an earlier group: most never come again and aren't worth remembering."""
        if len(piece) > LONGEST_REMEMBERED:
            return False
        slot = hash(piece) & self._slots
        met = self._met[slot]
        self._met[slot] = 1
        return met > 0

    def _ends(self, end: bytes) -> tuple[int, ...]:
        """Lengths, longest first, that tokens ending in ``end`` (four bytes at most) may have."""
        found = set().union(*(self._by_end.get(end[k:], ()) for k in range(len(end))))
        self._lengths[end] = out = tuple(sorted((n for n in found if n <= len(end) or len(end) == 4), reverse=True))
        return out

    def _encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of distinct pre-tokens: the trie traversal."""
        out: dict[str, bytes] = {}
        vocab, lengths, pairs, size = self.vocab, self._lengths, self._pairs, len(self.token_bytes)
        token_bytes, pack = self.token_bytes, struct.pack
        if len(pairs) > 1_000_000:
            pairs.clear()
        last: list[int] = [-1]  # the last token of each prefix on the current path
        vocab_get, pairs_get, push = vocab.get, pairs.get, last.append
        path = b""
        for word in sorted(words):  # code points sort as their UTF-8 bytes do
            piece = word.encode()
            depth, most = 0, min(len(path), len(piece))
            if path[:most] == piece[:most]:
                depth = most
            else:
                while path[depth] == piece[depth]:
                    depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, len(piece) + 1):
                tail = piece[end - 4 : end] if end > 4 else piece[:end]
                for length in lengths[tail] if tail in lengths else self._ends(tail):
                    start = end - length
                    if start > 0:
                        if (token := vocab_get(piece[start:end])) is not None:
                            key = last[start] * size + token
                            if (fits := pairs_get(key)) is None:
                                fits = pairs[key] = self._separate(last[start], token)
                            if fits:
                                break
                    elif not start and (token := vocab_get(piece[:end])) is not None:
                        break
                push(token)
            path, end, ids = piece, len(piece), []
            while end:
                token = last[end]
                ids.append(token)
                end -= len(token_bytes[token])
            ids.reverse()
            out[word] = pack(f"<{len(ids)}I", *ids)
        return out

    def _encode_plain(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of texts without special tokens, each cut into pre-tokens on its own."""
        cut = {piece: self._pretokens(piece) for piece in pieces}
        words: set[str] = set()
        words.update(*cut.values())
        known, chunks = self._words, self._chunks
        look: dict[str, bytes] = {}
        fresh = []
        for word in words:
            ids = chunks.get(word[1:]) if word[0] == " " else known.get(word)
            if ids:
                look[word] = ids
            else:
                fresh.append(word)
        new = self._encode_words(fresh)
        for word, ids in new.items():
            if self._again(word):
                if word[0] != " ":
                    known[word] = ids
                elif not word[1:2].isspace() and len(word) > 1:
                    chunks[word[1:]] = ids
                else:
                    continue
                self._held += 2 * len(word) + len(ids) + 200
        look.update(new)
        return {piece: look[words[0]] if len(words) == 1 else b"".join([look[w] for w in words]) for piece, words in cut.items()}

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        if self._held > MEMORY_BYTES:
            self._words, self._chunks, self._held = {}, {}, 0
        chunks = self._chunks
        get = chunks.get
        parts = [text.split(" ") for text in texts]
        found = [list(map(get, part)) for part in parts]
        wanted: set[str] = set()
        for part, ids in zip(parts, found, strict=True):
            if None in ids:
                wanted.update([p for p, x in zip(part, ids, strict=True) if x is None])
        # a piece that is empty or has white space at an end joins a run of white space: its text takes the slow way
        irregular = dict.fromkeys((p for p in wanted if not p or p[0].isspace() or p[-1].isspace()), False)
        encoded = self._encode_plain([" " + p for p in wanted if p not in irregular])
        new: dict[str, bytes | bool] = irregular
        for piece, ids in encoded.items():
            new[piece[1:]] = ids
        for piece, ids in new.items():
            if piece not in chunks and self._again(piece):
                self._held += 2 * len(piece) + len(ids or b"") + 200
                chunks[piece] = ids
        out: list[bytes | None] = []
        whole: list[str] = []
        for text, part, ids in zip(texts, parts, found, strict=True):
            if None in ids:
                ids = [new[p] if x is None else x for p, x in zip(part, ids, strict=True)]
            if False in ids[1:] or len(part) > 1 and (not part[0] or part[0][-1].isspace()):
                whole.append(text)
                out.append(b"")
            else:
                whole.append(part[0])  # no space stands before the first piece
                out.append(b"".join(ids[1:]))
        plain = self._encode_plain(set(whole))
        return [plain[text] + rest for text, rest in zip(whole, out, strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                out += self._encode_with_specials(group)
                group, chars = [], 0
        return out + self._encode_with_specials(group) if group else out

    def _encode_with_specials(self, texts: list[str]) -> list[bytes]:
        if self._special is None:
            return self._encode_group(texts)
        flat, owner, fixed = [], [], {}
        for i, text in enumerate(texts):
            pieces = self._special.split(text) if any(s in text for s in self.specials) else (text,)
            for k, piece in enumerate(pieces):
                if k % 2:
                    fixed[len(owner)] = struct.pack("<I", self.specials[piece])
                    owner.append(i)
                else:
                    owner.append(i)
                    flat.append(piece)
        ids = iter(self._encode_group(flat))
        if not fixed:
            return list(ids)
        out: list[list[bytes]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            out[i].append(fixed[k] if k in fixed else next(ids))
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids packed as by ``encode_batch``; bytes that aren't UTF-8 become U+FFFD."""
        table = self.token_bytes
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def encoder(path: str) -> TrieBpe:
    """One encoder for each Python worker."""
    return held(("bpe", path), lambda: TrieBpe(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, *, keep_ids: bool = True) -> DataFrame:
    """Ids, digests and the round trip of every text.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids`` (binary). A null text
    counts as empty: no ids, and the digests of nothing. Null and repeated document ids pass through, one row out
    for each row in; other columns are left behind. The vocabulary path must exist on every worker.
    """
    path = vocabulary or default_vocabulary()
    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, "text"):
            ids = bpe.encode_batch(batch.column("text").to_pylist())
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None) -> DataFrame:
    """Texts of packed ids, as ``doc_id, text``; null ids give a null text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, text string")
