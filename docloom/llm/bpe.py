"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list, and decoding by vocabulary strings.

A text is cut at special strings, then into pre-tokens by the vocabulary's public pattern; every distinct pre-token is
merged once per worker and its ids (little-endian unsigned 32-bit) are kept in a bounded cache (long ones aren't), so a text's ids are a
join of cached byte strings. Pre-tokens are merged either here (``BPE``) or by the tokenizers library (``LibraryBPE``);
both return the same ids.

Defined results: null text counts as empty and has no ids; no length is too long (a pre-token of n bytes takes
n log n steps, for which the linked list is there); columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import read_table, spread, tokenizer_path

#: Pre-tokens that each of a worker's two generations keeps (some 200 bytes each).
CACHE_WORDS = 500_000
_PLACE = (1 << 40) - 1
#: Fixed value: the public pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern over Latin-1, where its classes are short: the standard library's ``re`` has no \p but runs twice as fast.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
LATIN1_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_any, _latin1 = regex.compile(PATTERN).findall, re.compile(LATIN1_PATTERN).findall

#: Letters and numbers of newer Unicode tables, which this vocabulary's library takes for other signs (first, last); in the
#: first 65,536 code points and beyond.
NEWER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf),
    (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d),
)
NEWER_BEYOND = (
    (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb),
    (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8),
    (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2),
    (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24),
    (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5),
    (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)


def _ranges(pairs: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)


_NEW = _ranges(NEWER + NEWER_BEYOND)
_older = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_NEW}]]+| ?[\p{{N}}--[{_NEW}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{_NEW}]]+|\s+(?!\S)|\s+").findall
# Most texts have no such sign: two scans by short classes tell.
_newer, _beyond, _newer_beyond = re.compile(f"[{_ranges(NEWER)}]").search, re.compile("[\U00010000-\U0010ffff]").search, re.compile(f"[{_ranges(NEWER_BEYOND)}]").search


def pretokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _newer(text) or (_beyond(text) and _newer_beyond(text)):
            return _older(text)
        return _any(text)
    return _latin1(text)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next free sign from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Pre-token -> its ids as bytes, in two generations: when the young one is full it becomes the old one, whose hits come back."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.encode(word)).tobytes()
        if len(word) < 256:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BPE:
    """The operator's own encoder and decoder over a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, signs = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [vocab[s] for s in signs]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[left], vocab[right]] = (rank, vocab[left + right])
        back = {s: b for b, s in enumerate(signs)}
        special = {x["id"]: x["content"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special]) + 1
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = token.encode() if i in special else bytes(back[c] for c in token)
        for i, content in special.items():
            self.piece[i] = content.encode()
        self.special = {content: np.array([i], "<u4").tobytes() for i, content in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.words = _Words(self.encode_word)

    def encode_word(self, word: str) -> list[int]:
        """Merge one pre-token: the best-ranked pair first, leftmost among equals; stale queue entries are skipped."""
        symbol = [self.byte_id[b] for b in word.encode()]
        n = len(symbol)
        if n < 2:
            return symbol
        rank = self.rank
        before, after = range(-1, n - 1), [*range(1, n), -1]
        # four bytes a link where a word is long: millions of signs without a break must fit in a worker
        keep = list if n < 4096 else (lambda values: array("i", values))
        symbol, before, after = keep(symbol), keep(before), keep(after)
        # an entry is rank * 2^40 + place; it is stale if the pair that now begins there has another rank
        queue = [(found[0] << 40) + i for i in range(n - 1) if (found := rank.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & _PLACE
            j = after[i]
            found = rank.get((symbol[i], symbol[j])) if j >= 0 and symbol[i] >= 0 else None
            if found is None or found[0] != entry >> 40:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = found[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := rank.get((symbol[i], symbol[k])):
                    heapq.heappush(queue, (found[0] << 40) + i)
            h = before[i]
            if h >= 0 and (found := rank.get((symbol[h], symbol[i]))):
                heapq.heappush(queue, (found[0] << 40) + h)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> bytes:
        """All ids of a text, little-endian unsigned 32-bit."""
        get = self.words.__getitem__
        if self.cut is None or "<" not in text or self.cut.search(text) is None:
            return b"".join(map(get, pretokens(text)))
        parts = self.cut.split(text)
        return b"".join(self.special[p] if k % 2 else b"".join(map(get, pretokens(p))) for k, p in enumerate(parts))

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Concatenated vocabulary strings; ids beyond the vocabulary give nothing, broken UTF-8 the replacement sign."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return b"".join(map(self.piece.__getitem__, ids[ids < len(self.piece)].tolist())).decode("utf-8", "replace")


class LibraryBPE(BPE):
    """The same, with each distinct pre-token encoded by the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path).model  # its ids are those of encode(); a pre-token needs no further splitting
        self._signs = {b: s for b, s in enumerate(byte_symbols())}

    def encode_word(self, word: str) -> list[int]:
        return [t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._signs))]


_LOADED: dict[tuple[str, bool], BPE] = {}


def loaded(path: str, library: bool = False) -> BPE:
    """One encoder per worker process and file."""
    key = (path, library)
    if key not in _LOADED:
        _LOADED[key] = (LibraryBPE if library else BPE)(path)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ``ids`` holds little-endian unsigned 32-bit token ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ids = [bpe.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], schema=out)

    return spread(rows).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encode_documents``."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i.as_py() or b"") for i in b.column(1)], pa.string())], schema=out)

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so ids never leave the worker."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], schema=out)

    return spread(rows).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())
