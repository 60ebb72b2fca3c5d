"""Suffix-array dedup: removes bytes covered by a 100-byte string that also starts earlier in the corpus.

1. Texts that are equal as a whole collapse to the first of them; in the copies all is removed (if it is long enough).
2. Every window of ``span`` bytes picks the smallest of its 16-byte gram hashes as its *anchor* (leftmost among equals): what
   a window picks depends on its bytes alone, so equal windows have their anchors at the same place in them. Anchors
   stand a few dozen bytes apart, and only they are counted over the corpus (see ``exchange``); windows whose anchor's gram occurs
   once can't repeat.
3. The other anchors' contexts (what their windows reach to the left and right) go, packed, to hash ranges of the gram.
   There a sparse suffix array orders the texts that start at the anchors, and another one those that run back from them, by
   deep-shallow sorting: a multikey quicksort over 8-byte characters (all groups at once, in numpy) down to ``SHALLOW`` bytes;
   groups that are still tied have long common prefixes and are ordered by blind tries. With both arrays' common-prefix lengths,
   windows at distance l before the anchor are equal where neither length falls below what l needs.
4. Of equal windows the first (smallest id, then start) stays; intervals of the others return to the documents' chunks,
   where their union is cut out.

Within a chunk, anchors with equal contexts send one record only (the later ones are decided on the spot), so a passage that
millions share is one record a chunk. A gram of more than ``HOT_GRAM`` anchors, whose surroundings may differ in all of them, has its
records dealt out by bands of l: a band's windows agree in the bytes that all of them need, and a hash of these is their key.

Defined results: null text counts as empty; texts shorter than ``span`` lose nothing; null ids come before all others; rows
with one id follow each other in an arbitrary but fixed order; no rows, no result. Removed bytes may cut characters; the
text that ``drop_repeats`` returns leaves out what is left of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import MULTIPLIERS, discard, fresh, materialize, mixed, read_table, release
from docloom.llm.exact_dedup import with_groups
from docloom.llm.exchange import ASK_DDL, ask_table, chunk_documents, compress, doc_columns, expand, gathered, look_up, range_of, rows_of

SPAN, GRAM, SHALLOW = 100, 16, 32
_GRAMS = SPAN - GRAM + 1  # in a window
_POS = np.uint64(24)
#: Records that are sorted at once (a gram with more is sorted as a whole).
BATCH = 32_768
#: Bytes of text in a chunk (one task's unit of work), and of those whose windows are hashed at once.
CHUNK, _PIECE = 4 << 20, 1 << 20
#: Anchors of one gram in the corpus above which its records are dealt out by what stands around them.
HOT_GRAM = 4096
#: Bands of the distance l between a window's start and its anchor, which double in width from both ends.
_BANDS = ((0, 0), (1, 1), (2, 3), (4, 7), (8, 15), (16, 41), (42, 68), (69, 76), (77, 80), (81, 82), (83, 83), (84, 84))
#: Chunks for each range that sorts contexts. Rows between chunks and ranges hold a record at least, so they follow the records.
CHUNKS_A_RANGE = 2


# --- anchors ---------------------------------------------------------------------------------------------------------


def _words_at_each_byte(data: bytes, count: int) -> np.ndarray:
    """The 8 bytes from each of the first ``count`` places, as little-endian numbers."""
    out = np.empty(count, np.uint64)
    padded = data + bytes(16)
    for k in range(min(8, count)):
        own = out[k::8]
        own[:] = np.frombuffer(padded, "<u8", len(own), k)
    return out


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram key, document index, anchor, first window, last window) in a block of documents; places count in the block."""
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at + SPAN <= len(data):
        piece = data[at : at + _PIECE]
        n = len(piece) - GRAM + 1
        words = _words_at_each_byte(piece, n + 8)
        keys = mixed(words[:n] * MULTIPLIERS[0] + words[8 : n + 8] * MULTIPLIERS[1])
        low = ((keys >> _POS) << _POS) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= _GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = _GRAMS - width
        low = np.minimum(low[: len(low) - rest], low[rest:])  # low[p]: of the window at p
        p = np.arange(at, at + len(low))
        doc = np.searchsorted(ends, p, side="right")
        valid = np.flatnonzero((doc < len(ends)) & (p + SPAN <= ends[np.minimum(doc, len(ends) - 1)]))
        if len(valid):
            pick, owner = low[valid], doc[valid]
            edge = np.concatenate(([True], (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(valid) != 1)))
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(valid)) - 1
            chosen = (pick[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
            # smallest hashes lie near zero: mixed once more, they spread evenly over the hash ranges
            found.append((mixed(keys[chosen]), owner[first], chosen + at, valid[first] + at, valid[last] + at))
        at += len(low)  # the windows after these start here
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# --- deep-shallow sorting --------------------------------------------------------------------------------------------


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts) of rows of 64-bit characters: ternary partitioning, every open group split at once.

    Rows of one group are equal in all characters.
    """
    n, depth_end = keys.shape
    order, group = np.arange(n), np.zeros(n, np.int64)  # of each place, the group's number
    depth = np.zeros(1, np.int64)
    size = np.array([n], np.int64)
    while True:
        open_ = (size > 1) & (depth < depth_end)
        if not open_.any():
            break
        starts = np.cumsum(size) - size
        place = np.flatnonzero(open_[group])
        g = group[place]
        own = keys[order[place], depth[g]]
        # a median of three as each group's pivot
        probes = [keys[order[starts + off], np.minimum(depth, depth_end - 1)] for off in (np.zeros_like(size), size // 2, size - 1)]
        pivot = np.maximum(np.minimum(probes[0], probes[1]), np.minimum(np.maximum(probes[0], probes[1]), probes[2]))
        side = np.ones(n, np.int64)
        side[place] = (own > pivot[g]).astype(np.int64) - (own < pivot[g]) + 1
        rank = group * 3 + side
        moved = np.argsort(rank[place], kind="stable")
        order[place] = order[place][moved]
        rank[place] = rank[place][moved]
        edge = np.concatenate(([True], rank[1:] != rank[:-1]))
        first = np.flatnonzero(edge)
        parent, middle = rank[first] // 3, rank[first] % 3 == 1
        depth = depth[parent] + (middle & open_[parent])
        size = np.diff(np.append(first, n))
        group = np.cumsum(edge) - 1
    return order, np.cumsum(size) - size


class BlindTrie:
    """Patricia trie over byte strings: inner nodes know only where their children part; one comparison verifies."""

    def __init__(self, first: bytes, leaf: int):
        self.root: tuple | list = (first, [leaf])  # a leaf is (string, members), an inner node [depth, {byte: node}]

    def insert(self, text: bytes, leaf: int) -> None:
        node = self.root
        while isinstance(node, list):  # blind: skipped characters aren't looked at
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        known = node[0]
        if known == text:
            node[1].append(leaf)
            return
        common = next(i for i, (x, y) in enumerate(zip(known, text, strict=True)) if x != y)
        above, node = None, self.root
        while isinstance(node, list) and node[0] < common:
            above, node = (node, text[node[0]]), node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == common:
            node[1][text[common]] = (text, [leaf])
            return
        fork = [common, {known[common]: node, text[common]: (text, [leaf])}]
        if above is None:
            self.root = fork
        else:
            above[0][1][above[1]] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def deep_shallow_sort(gram: np.ndarray, texts: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before) of byte rows within equal ``gram`` keys; -1 where a new gram begins."""
    n, width = texts.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = texts
    shallow_words = padded[:, :shallow].copy().view(">u8").astype(np.uint64)
    order, starts = multikey_quicksort(np.column_stack([gram, shallow_words]))
    del shallow_words
    ends = np.append(starts[1:], n)
    # tied groups whose rows are one and the same need no trie
    whole = np.zeros(n, np.uint64)
    for k, column in enumerate(padded.view("<u8").T):
        whole = mixed(whole * MULTIPLIERS[0] + column * MULTIPLIERS[1] + np.uint64(k))
    del padded
    differs = whole[order] != whole[order[np.repeat(starts, ends - starts)]]
    for k in np.unique(np.searchsorted(starts, np.flatnonzero(differs), side="right") - 1):
        rows = order[starts[k] : ends[k]]
        trie = BlindTrie(texts[rows[0]].tobytes(), int(rows[0]))
        for r in rows[1:].tolist():
            trie.insert(texts[r].tobytes(), r)
        order[starts[k] : ends[k]] = trie.ordered()
    common = np.full(n, -1, np.int64)
    for lo in range(1, n, 1 << 14):
        hi = min(n, lo + (1 << 14))
        a, b = order[lo - 1 : hi - 1], order[lo:hi]
        unequal = texts[a] != texts[b]
        length = np.where(unequal.any(1), unequal.argmax(1), width)
        common[lo:hi] = np.where(gram[a] == gram[b], length, -1)
    return order, common


def repeated_windows(gram: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(record, l) matrix: the window ``l`` bytes before the anchor also starts earlier. Records are in corpus order.

    ``left`` holds the bytes before the anchor, backwards; ``low`` and ``high`` bound the l of the windows that picked it.
    """
    n = len(gram)
    removed = np.zeros((n, _GRAMS), bool)
    if n < 2:
        return removed
    order_l, common_l = deep_shallow_sort(gram, left)
    order_r, common_r = deep_shallow_sort(gram, right)
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(_GRAMS):
        active = np.flatnonzero((low <= l) & (l <= high))
        if len(active) < 2:
            continue
        class_l[order_l] = np.cumsum(common_l < l)
        class_r[order_r] = np.cumsum(common_r < SPAN - l)
        key = class_l[active] * (n + 1) + class_r[active]
        sort = np.argsort(key, kind="stable")  # corpus order within equal windows
        again = np.concatenate(([False], key[sort][1:] == key[sort][:-1]))
        removed[active[sort[again]], l] = True
    return removed


# --- plan ------------------------------------------------------------------------------------------------------------


def _block(row: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    _, lengths, _ = doc_columns(row)
    ends = np.cumsum(lengths)
    return expand(row["body"]), ends - lengths, ends


def _ask(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                keys, counts = np.unique(anchors(*_block(row))[0], return_counts=True)
                yield from ask_table(_COUNTS, row["chunk"], keys, [counts]).to_batches()
                del row
                release()

    return chunks.mapInArrow(run, ASK_DDL)


_PART_DDL = "kind int, bucket long, chunk long, payload binary"
_PART = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
_COPIES, _COUNTS, _RECORDS, _CUTS = range(4)


def _classes(hot: int):
    """0: occurs once, 1: repeated, 2: so often that its records are split among many keys."""

    def classes(totals: list[np.ndarray]) -> list[np.ndarray]:
        return [(totals[0] > 1).astype(np.uint8) + (totals[0] > max(hot, 1))]

    return classes


def _split_hot(keys: np.ndarray, hot: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """(record, key, low, high): the windows of a hot gram's records in bands of l, each under a key of its own.

    Windows at distance l need the nearest l bytes on the left and SPAN - l on the right. All windows of a band [a, b] need the
    nearest ``a`` on the left and ``SPAN - b`` on the right, so equal ones agree there, and a hash of those bytes deals
    the records out. Bands double from both ends: few bytes are left to differ in the outer ones.
    """
    plain = np.flatnonzero(~hot)
    found = [(plain, keys[plain], low[plain], high[plain])]
    rows = np.flatnonzero(hot)
    for a, b in _BANDS if len(rows) else ():
        first, last = np.maximum(low[rows], a), np.minimum(high[rows], b)
        own = rows[first <= last]
        key = keys[own] * MULTIPLIERS[0] + np.uint64(a + 1)
        for side in (before[own, :a], after[own, : SPAN - b]):
            for column in side.T:
                key = mixed(key * MULTIPLIERS[1] + column)
        found.append((own, key, first[first <= last], last[first <= last]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _copies(right: pa.Table) -> np.ndarray:
    """Places of a chunk's documents that copy an earlier text."""
    for kind, payload in zip(right.column("kind").to_pylist(), right.column("payload"), strict=True):
        if kind == _COPIES:
            return np.array(sorted(map(int, payload.as_py().split(b","))), np.int64)
    return np.zeros(0, np.int64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Columns of equal length in one frame, so that even a row of one record costs little more than that record."""
    return len(arrays[0]).to_bytes(8, "little") + compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, kinds: tuple[tuple[str, int], ...]) -> list[np.ndarray]:
    """Columns of (dtype, width) that ``_pack`` wrote."""
    n, body, out, at = int.from_bytes(data[:8], "little"), expand(data[8:]), [], 0
    for kind, width in kinds:
        out.append(np.frombuffer(body, kind, n * width, at).reshape((n, width) if width > 1 else n))
        at += out[-1].nbytes
    return out


_CUT_KINDS = (("<i8", 1),) * 3
_RECORD_KINDS = (("<u8", 1), ("<i8", 1), ("u1", 1), ("<i8", 1), ("<i8", 1), ("u1", 1), ("u1", 1), ("u1", _GRAMS - 1), ("u1", SPAN))
_LEFT = _GRAMS - 1


def _records(ranges: int):
    """Contexts of the anchors that may repeat, cut into hash ranges; what is decided within the chunk goes out as cuts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _PART.empty_table()
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        data, starts, ends = _block(row)
        ids, _, nulls = doc_columns(row)
        keys, owner, anchor, first, last = anchors(data, starts, ends)
        if not len(keys):
            return _PART.empty_table()
        kind_of = gathered(right.rename_columns(["kind", "bucket", "chunk", "counts"]), _COUNTS, 1)[0][np.searchsorted(np.unique(keys), keys)]
        take = (kind_of > 0) & ~np.isin(owner, _copies(right))
        keys, owner, anchor, first, last, kind_of = (x[take] for x in (keys, owner, anchor, first, last, kind_of))
        if not len(keys):
            return _PART.empty_table()
        low, high = (anchor - last).astype(np.uint8), (anchor - first).astype(np.uint8)
        text = np.frombuffer(bytes(SPAN) + data + bytes(SPAN), np.uint8)
        around = np.lib.stride_tricks.sliding_window_view(text, _LEFT + SPAN)[anchor + SPAN - _LEFT]
        before, after = around[:, :_LEFT][:, ::-1].copy(), around[:, _LEFT:].copy()
        del around
        own, keys, low, high = _split_hot(keys, kind_of > 1, low, high, before, after)
        owner, anchor, before, after = owner[own], anchor[own], before[own], after[own]
        # only what the windows reach: the rest would tell equal windows apart, and cost
        before[np.arange(_LEFT)[None, :] >= high[:, None]] = 0
        after[np.arange(SPAN)[None, :] >= (SPAN - low.astype(np.int64))[:, None]] = 0
        order = np.lexsort((anchor, owner, ids[owner], ~nulls[owner]))
        keys, owner, anchor, low, high, before, after = (x[order] for x in (keys, owner, anchor, low, high, before, after))
        whole = np.column_stack([before, after, low, high, keys.view(np.uint8).reshape(-1, 8)])
        _, head = np.unique(whole.view([("", "V%d" % whole.shape[1])]).reshape(-1), return_index=True)
        sent = np.zeros(len(keys), bool)
        sent[head] = True
        rows: list[tuple] = []
        again = ~sent
        if again.any():
            o = owner[again]
            rows.append((_CUTS, None, row["chunk"], _pack([o, anchor[again] - high[again] - starts[o], anchor[again] - low[again] - starts[o]])))
        keys, owner, anchor, low, high, before, after = (x[sent] for x in (keys, owner, anchor, low, high, before, after))
        by_key = np.argsort(keys, kind="stable")
        cuts = range_of(keys[by_key], ranges)
        for r in np.flatnonzero(np.diff(cuts)):
            own = by_key[cuts[r] : cuts[r + 1]]
            o = owner[own]
            rows.append((_RECORDS, int(r), row["chunk"], _pack([keys[own], ids[o], nulls[o].astype(np.uint8), o, anchor[own] - starts[o], low[own], high[own], before[own], after[own]])))
        out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PART, strict=True)], schema=_PART)
        del rows, data, text, whole, before, after
        release()
        return out

    return run


def _decide(table: pa.Table) -> pa.Table:
    """A range's records to cuts, one row for each chunk; grams are decided in batches, so only the packed contexts are held as a whole."""
    chunks = table.column("chunk").to_pylist()
    parts = [_unpack(p.as_py(), _RECORD_KINDS) for p in table.column("payload")]
    gram, ids, nulls, owner, anchor, low, high = (np.concatenate([p[i] for p in parts]) for i in range(7))
    n = len(gram)
    contexts = np.empty((n, _LEFT + SPAN), np.uint8)
    at = 0
    for p in parts:
        m = len(p[0])
        contexts[at : at + m, :_LEFT], contexts[at : at + m, _LEFT:] = p[7], p[8]
        at += m
    chunk = np.repeat(np.array(chunks, np.int64), [len(p[0]) for p in parts])
    del parts
    order = np.lexsort((anchor, owner, chunk, ids, nulls == 0, gram))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(gram[order]) != 0, [True])))
    found: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < n:
        k = int(np.searchsorted(edges, lo + BATCH, side="right")) - 1
        hi = int(edges[k]) if edges[k] > lo else int(edges[k + 1])  # whole grams, one at least
        own = order[lo:hi]
        removed = repeated_windows(gram[own], contexts[own, :_LEFT], contexts[own, _LEFT:], low[own].astype(np.int64), high[own].astype(np.int64))
        grid = np.zeros((len(own), _GRAMS + 2), np.int8)
        grid[:, 1:-1] = removed
        i, begin = np.nonzero((grid[:, 1:] == 1) & (grid[:, :-1] == 0))
        _, end = np.nonzero((grid[:, 1:] == 0) & (grid[:, :-1] == 1))
        k = own[i]
        found.append((chunk[k], owner[k], anchor[k] - (end - 1), anchor[k] - begin))
        del removed, grid
        lo = hi
    del contexts
    release()
    chunk, owner, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = []
    for c in np.unique(chunk):
        mine = chunk == c
        rows.append((_CUTS, None, int(c), _pack([owner[mine], first[mine], last[mine]])))
    if not rows:
        return _PART.empty_table()
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PART, strict=True)], schema=_PART)


_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string()), ("text_sha256", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        data, starts, ends = _block(row)
        ids, lengths, nulls = doc_columns(row)
        steps = np.zeros(len(data) + 1, np.int32)
        for kind, payload in zip(right.column("kind").to_pylist(), right.column("payload"), strict=True):
            if kind == _CUTS:
                owner, first, last = _unpack(payload.as_py(), _CUT_KINDS)
                np.add.at(steps, starts[owner] + first, 1)
                np.add.at(steps, starts[owner] + last + SPAN, -1)
        copies = _copies(right)
        copies = copies[lengths[copies] >= SPAN]
        np.add.at(steps, starts[copies], 1)
        np.add.at(steps, ends[copies], -1)
        gone = np.cumsum(steps[:-1]) > 0
        text = np.frombuffer(data, np.uint8)
        rows = []
        for k in range(len(ids)):
            g = gone[starts[k] : ends[k]]
            kept = text[starts[k] : ends[k]][~g].tobytes() if g.any() else data[starts[k] : ends[k]]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
            rows.append((None if nulls[k] else int(ids[k]), len(g), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "ignore"), hashlib.sha256(data[starts[k] : ends[k]]).hexdigest()) if with_text else ()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_gram: int = HOT_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text, text_sha256] of every row; text_sha256 is that of the whole text."""
    spark = docs.sparkSession
    chunks = chunk_documents(docs, lambda texts: compress(b"".join(texts)), id_col, text_col, CHUNK, name="text-chunks")
    ddl = "chunk long, place int, doc_id long, digest binary"
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                data, starts, ends = _block(row)
                ids, _, nulls = doc_columns(row)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, mask=nulls), pa.array([hashlib.sha256(data[s:e]).digest() for s, e in zip(starts, ends, strict=True)], pa.binary())], schema=schema)

    listed = materialize(chunks.mapInArrow(digests, ddl), "digests")
    count = chunks.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // CHUNKS_A_RANGE))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "chunk", "place")
    headed = with_groups(listed, "digest", F.min(order).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = headed.where((F.col("chunk") != F.col("head.chunk")) | (F.col("place") != F.col("head.place")))
    copies = materialize(later.groupBy("chunk").agg(F.array_join(F.collect_list("place"), ",").cast("binary").alias("payload")).select(F.lit(_COPIES).alias("kind"), F.lit(None).cast("long").alias("bucket"), "chunk", "payload"), "copies")
    answers = materialize(look_up(_ask(chunks), count, _classes(hot_gram), 1).where("node is not null").select("kind", F.col("bucket"), F.col("node").alias("chunk"), F.col("counts").alias("payload")), "repeated")
    parts = materialize(chunks.groupBy("chunk").cogroup(answers.unionByName(copies).groupBy("chunk")).applyInArrow(_records(ranges), _PART_DDL), "contexts")
    discard(answers)
    cuts = materialize(parts.where(F.col("kind") == _RECORDS).groupBy("bucket").applyInArrow(_decide, _PART_DDL).unionByName(parts.where(F.col("kind") == _CUTS)), "cuts")
    discard(parts)
    return chunks.groupBy("chunk").cogroup(cuts.unionByName(copies).groupBy("chunk")).applyInArrow(_cut(with_text), _OUT_DDL + ", text string, text_sha256 string" * with_text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


#: The same by SQL: every 100-byte string of every document by its digest, and the union of the repeated ones.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM s),
r AS (SELECT doc_id, p, p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS new FROM f WHERE again),
i AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
c AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY ALL),
k AS (SELECT doc_id, b AS a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM c UNION ALL SELECT doc_id, 0, min(a) FROM c GROUP BY doc_id),
t AS (SELECT d.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (coalesce(k.b, d.n) - k.a)), '' ORDER BY k.a) AS kept FROM d JOIN k USING (doc_id) GROUP BY d.doc_id),
m AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts; every document stays, its other columns as they were.

    Texts that lose nothing are not touched (null stays null). A row finds its cut text by id (null is an id here) and whole
    text, so rows of one id keep texts of their own. Of rows equal in both all but one lose everything, if they lose anything.
    """
    key, row, text, n, nth = fresh(docs.columns, "cut_key", "row_key", "cut_text", "cut_rows", "cut_nth")
    said = lambda of, digest: F.concat_ws(":", of.cast("long").cast("string"), digest)  # noqa: E731 (null ids have no colon)
    cut = suffix_dedup(docs, id_col, text_col, with_text=True).where("n_removed > 0").groupBy(said(F.col("doc_id"), F.col("text_sha256")).alias(key)).agg(F.max("text").alias(text), F.count(F.lit(1)).alias(n))
    joined = docs.withColumn(row, said(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))).join(cut, F.col(row) == F.col(key), "left")
    # of n equal rows that lost bytes, n - 1 at least lost them all; a row beyond those n lost none
    placed = joined.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    told = F.when(F.col(nth) > F.coalesce(F.col(n), F.lit(0)), F.col(text_col)).when(F.col(nth) == 1, F.col(text)).otherwise("")
    return placed.withColumn(text_col, told).select(*docs.columns)
