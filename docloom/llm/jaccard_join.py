"""Similarity self-join on word shingles with adaptive multi-match prefixes, and the components of its links.

Two documents link when 100 * |x & y| >= 75 * |x | y| over their sets of distinct five-word shingles.

1. Documents with one and the same set collapse to a class (its smallest id): copies never meet in a join.
2. Shingles are counted over all classes (see ``exchange``), which gives a global order, rarest first. A shingle of one
   document only can't be shared.
3. Adaptive multi-match prefixes: linked sets share at least L shingles within their first |x| - ceil(0.75 |x|) + L
   shingles, for any L. Each document takes the L with the least estimated cost, which is the length of the posting
   lists its prefix reads plus the candidates these can yield when L matches are asked for, times their
   verification. A pair must then share min(L, L') prefix shingles before it is verified. Where a prefix has fewer than L shared
   shingles at all, the document has no link.
4. Lists of at most ``hot`` documents yield pairs (so rows grow with the postings, not with their square), which are counted,
   checked against L and verified on whole sets.
5. A longer list first yields a star: each member with a few pivots of the list. What that links is settled; a list whose
   members all lie in one component by now has nothing left to find, and a group of near copies ends here after linear work.
6. The lists that are left are joined block by block with the same counts and filters: members whose sizes may link
   (sizes in bands of the threshold's ratio, so only equal and adjacent bands meet) count their common prefix shingles
   by a matrix product, must share min(L, L'), and are verified on whole sets if their components differ. A block has at most
   ``BLOCK_DOCS`` documents a side in the mean, and emits a spanning forest of its links only. That is exact: a pair
   that shares a prefix shingle of a long list lies in one cluster, and any other pair's matches are all in short lists.
7. Components of the links, then back from classes to documents.

Defined results: null or blank text has an empty set, links with nothing and is its own component; fewer than five words are
one shingle of the whole sequence; rows with the same id are one node; null ids have no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import MULTIPLIERS, discard, fresh, materialize, mixed, read_table, release, word_hashes
from docloom.llm.components import connected_components
from docloom.llm.exact_dedup import with_groups
from docloom.llm.exchange import ASK, ASK_DDL, ask_table, chunk_documents, doc_columns, gathered, look_up, pack_keys, pack_numbers, rows_of, unpack_keys, unpack_numbers

WORDS, PERCENT = 5, 75
HOT, BLOCK_BYTES, BLOCK_DOCS = 48, 4 << 20, 512
_MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text whose word hashes are ``h``."""
    n = len(h)
    if not n:
        return h
    size = min(n, words)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)  # a short sequence never equals a whole shingle
    for k in range(size):
        out += h[k : n - size + 1 + k] * MULTIPLIERS[k]
    out = np.sort(mixed(out))
    return out[np.append(True, out[1:] != out[:-1])]


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def encode_words(texts: list[bytes]) -> bytes:
    """A chunk's body: distinct word hashes, a code for each word, words of each document; then sizes and digests of their sets."""
    hashes = [word_hashes(t) for t in texts]
    sets = [shingles(h) for h in hashes]
    keys, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    blobs = [pack_keys(keys), pack_numbers(codes), np.array([len(h) for h in hashes], "<i8").tobytes()]
    blobs += [np.array([len(s) for s in sets], "<i8").tobytes(), b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)]
    del hashes, sets, codes
    release()
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _parts(row: dict) -> list[bytes]:
    blobs, at, body = [], 0, row["body"]
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        blobs.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return blobs


def _sets(row: dict, places: list[int]) -> list[np.ndarray]:
    """Shingle sets of the documents at ``places``."""
    keys, codes, counts = _parts(row)[:3]
    h, ends = unpack_keys(keys)[unpack_numbers(codes)], np.cumsum(np.frombuffer(counts, "<i8"))
    starts = ends - np.frombuffer(counts, "<i8")
    return [shingles(h[starts[p] : ends[p]]) for p in places]


_SET_DDL = "chunk long, place int, doc_id long, n_shingles long, digest binary"
_SET = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())])


def _describe(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                ids, _, nulls = doc_columns(row)
                sizes, digests = _parts(row)[3:]
                columns = [np.full(len(ids), row["chunk"]), np.arange(len(ids), dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, mask=nulls), pa.array(np.frombuffer(sizes, "<i8")), pa.array([digests[k : k + 16] for k in range(0, len(digests), 16)], pa.binary())], schema=_SET)

    return chunks.mapInArrow(run, _SET_DDL)


_PLACES = 0


def _places(right: pa.Table) -> list[int]:
    """Which documents of a chunk stand for a class: the row of that kind."""
    for kind, payload in zip(right.column("kind").to_pylist(), right.column("counts"), strict=True):
        if kind == _PLACES:
            return sorted(map(int, payload.as_py().split(b",")))
    return []


def _chunk_row(left: pa.Table) -> dict:
    return {c: left.column(c)[0].as_py() for c in left.column_names}


def _ask(mask: np.uint64):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places = _places(right)
        if not left.num_rows or not places:
            return ASK.empty_table()
        row = _chunk_row(left)
        keys, counts = np.unique(np.concatenate(_sets(row, places)) & mask, return_counts=True)
        out = ask_table(1, row["chunk"], keys, [counts])
        del row, keys, counts
        release()
        return out

    return run


def _clipped(totals: list[np.ndarray]) -> list[np.ndarray]:
    return [np.minimum(totals[0], 2**32 - 1)]


def choose_prefix(frequency: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(matches asked for, prefix length) of least estimated cost for a set whose sorted frequencies are given."""
    least = -(-percent * n // 100)  # the overlap that any link needs
    reads = np.cumsum(np.where(frequency > 1, frequency, 0).astype(np.float64))
    best = (np.inf, 1, n - least + 1)
    for matches in _MATCHES:
        if matches > least:
            break
        length = n - least + matches
        cost = reads[length - 1] * (1 + n / (16 * matches))
        if cost < best[0]:
            best = (cost, matches, length)
    return best[1], best[2]


_PREFIX_DDL = "node long, n int, matches int, tokens array<long>, set binary"
_PREFIX = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("matches", pa.int32()), ("tokens", pa.list_(pa.int64())), ("set", pa.binary())])


def _prefixes(mask: np.uint64, percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places = _places(right)
        if not left.num_rows or not places:
            return _PREFIX.empty_table()
        row = _chunk_row(left)
        ids, _, _ = doc_columns(row)
        sets = _sets(row, places)
        frequency = gathered(right, 1, 4)[0][np.unique(np.concatenate(sets) & mask, return_inverse=True)[1]].astype(np.int64)
        out: list[list] = [[], [], [], [], []]
        at = 0
        for p, s in zip(places, sets, strict=True):
            f = frequency[at : at + len(s)]
            at += len(s)
            n = len(s)
            if np.count_nonzero(f > 1) < -(-percent * n // 100):
                continue  # too many shingles that nobody shares
            order = np.lexsort((s, f))
            matches, length = choose_prefix(f[order], n, percent)
            head = order[:length]
            head = head[f[head] > 1]
            if len(head) < matches:
                continue
            # nobody else has the other shingles: they only count as a part of n
            for column, value in zip(out, (int(ids[p]), n, matches, s[head].view(np.int64), s[f > 1].astype("<u8").tobytes()), strict=True):
                column.append(value)
        found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PREFIX, strict=True)], schema=_PREFIX)
        del out, sets, frequency
        release()
        return found

    return run


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            sizes = zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True)
            for k, (x, y, (n, m)) in enumerate(zip(b.column("set_a"), b.column("set_b"), sizes, strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
                keep[k] = 100 * common >= percent * (n + m - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], schema=_EDGE)
            del b, mask
            release()

    return run


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of two lists of sets: products of dense 0/1 slabs for frequent tokens, pair counts for others."""
    h, w = len(rows), len(columns)
    tokens, place = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in (rows, columns)])
    split = sum(map(len, rows))
    sides = [(place[:split], owner[:split]), (place[split:], owner[split:])]
    counts = [np.bincount(p, minlength=len(tokens)) for p, _ in sides]
    product = counts[0] * counts[1]
    out = np.zeros(h * w, np.float32)
    # rare tokens: every left entry with the right entries of its token, a bounded number of pairs at a time
    rare = (product > 0) & (product < 2048)
    (lt, lo), (rt, ro) = ((p[rare[p]], o[rare[p]]) for p, o in sides)
    by_token = np.argsort(rt, kind="stable")
    ro, starts = ro[by_token], np.cumsum(np.where(rare, counts[1], 0)) - np.where(rare, counts[1], 0)
    repeats = counts[1][lt]
    edges = np.searchsorted(np.cumsum(repeats), np.arange(1 << 20, int(repeats.sum()) + (1 << 20), 1 << 20), side="left") + 1
    at = 0
    for end in np.minimum(edges, len(lt)):
        r, first = repeats[at:end], starts[lt[at:end]]
        inner = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
        pair = np.repeat(lo[at:end], r) * w + ro[np.repeat(first, r) + inner]
        out += np.bincount(pair, minlength=h * w).astype(np.float32)
        at = end
    out = out.reshape(h, w)
    frequent = np.flatnonzero(product >= 2048)
    slot = np.full(len(tokens), -1, np.int64)
    for low in range(0, len(frequent), 2048):
        part = frequent[low : low + 2048]
        slot[:] = -1
        slot[part] = np.arange(len(part))
        slabs = []
        for (p, o), size in zip(sides, (h, w), strict=True):
            slab, at_ = np.zeros((size, len(part)), np.float32), slot[p]
            slab[o[at_ >= 0], at_[at_ >= 0]] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    return out


def spanning_forest(links: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """The smallest reachable index of each, by label propagation with pointer jumping."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, links[0], label[links[1]])
        np.minimum.at(label, links[1], label[links[0]])
        label = label[label]
        if (label == before).all():
            return label


def _verify_block(percent: int):
    """Links between two blocks (or within one) as a spanning forest of edges between the components known so far."""

    def run(table: pa.Table) -> pa.Table:
        labels = table.column("label").to_numpy()
        if (labels == labels[0]).all():
            return _EDGE.empty_table()
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        n, matches = table.column("n").to_numpy().astype(np.int64), table.column("matches").to_numpy()
        sides = [np.flatnonzero(~second), np.flatnonzero(second)]
        if not len(sides[1]):
            sides[1] = sides[0]
        elif not len(sides[0]):
            return _EDGE.empty_table()
        i, j = sides
        prefix = [np.frombuffer(x.values.to_numpy(zero_copy_only=False), np.int64) for x in table.column("tokens")]
        small, large = np.minimum.outer(n[i], n[j]), np.maximum.outer(n[i], n[j])
        wanted = (labels[i][:, None] != labels[j][None, :]) & (100 * small >= percent * large)
        if wanted.any():
            wanted &= overlaps([prefix[k] for k in i], [prefix[k] for k in j]) >= np.minimum.outer(matches[i], matches[j])
        rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(rows):
            return _EDGE.empty_table()
        sets, (i, j) = table.column("set"), (i[rows], j[columns])
        own = lambda at: [np.frombuffer(sets[int(k)].as_buffer(), "<u8") for k in at]
        common = overlaps(own(i), own(j)).astype(np.int64)
        x, y = np.nonzero(wanted[np.ix_(rows, columns)] & linked(common, n[i][:, None], n[j][None, :], percent))
        known, place = np.unique(np.concatenate([labels[i][x], labels[j][y]]), return_inverse=True)
        root = spanning_forest((place[: len(x)], place[len(x) :]), len(known))
        above = np.flatnonzero(root != np.arange(len(known)))
        del wanted, common, small, large
        release()
        return pa.Table.from_arrays([pa.array(known[above]), pa.array(known[root[above]])], schema=_EDGE)

    return run


def _pairs_of_short_lists(sized: DataFrame, hot: int, percent: int) -> DataFrame:
    """(a, b) that share enough prefix shingles in lists of at most ``hot`` documents: those bound the pairs."""
    cold = sized.where(F.col("size") <= hot).groupBy("token").agg(F.collect_list(F.struct("node", "n", "matches")).alias("l"))
    partner = f"filter(l, y -> y.node > x.node and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n))"
    pair = cold.select(F.explode("l").alias("x"), "l").select("x", F.explode(F.expr(partner)).alias("y"))
    counted = pair.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("common"), F.min(F.least("x.matches", "y.matches")).alias("need"))
    return counted.where("common >= need").select("a", "b")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """(cluster, band, i, band2, j, second, and the columns of members): each pair of blocks that may link, once.

    Bands are powers of the threshold's ratio, so two sizes that may link lie in one band or in adjacent ones.
    """
    banded = members.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("int"))
    size = F.ceil(F.greatest(F.sum(F.length("set")) / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_DOCS)).cast("int")
    cells = banded.groupBy("cluster", "band").agg(size.alias("blocks"))
    known = materialize(cells.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks")), "block-counts")
    count = lambda k: F.coalesce(F.try_element_at("blocks", F.col("band") + k), F.lit(0))
    placed = banded.join(known, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), count(0)).cast("int"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(1), n), f)
    none = F.expr("cast(array() as array<struct<band: int, i: int, band2: int, j: int, second: boolean>>)")
    cell = lambda b, i, c, j, second: F.struct(b.alias("band"), i.cast("int").alias("i"), c.alias("band2"), j.cast("int").alias("j"), second.alias("second"))
    band, own = F.col("band"), F.col("own")
    within = upto(count(0), lambda k: cell(band, F.least(own, k - 1), band, F.greatest(own, k - 1), own > k - 1))
    above = F.when(count(1) > 0, upto(count(1), lambda k: cell(band, own, band + 1, k - 1, F.lit(False)))).otherwise(none)
    below = F.when(count(-1) > 0, upto(count(-1), lambda k: cell(band - 1, k - 1, band, own, F.lit(True)))).otherwise(none)
    spread = placed.withColumn("at", F.explode(F.concat(within, above, below)))
    return spread.select("cluster", "at.*", *(c for c in members.columns if c != "cluster"))


def link_labels(prefixes: DataFrame, hot: int = HOT, percent: int = PERCENT) -> DataFrame:
    """(node, component) of every class that links to another; ``prefixes`` is a stored table."""
    postings = materialize(prefixes.select("node", "n", "matches", F.explode("tokens").alias("token")), "postings")
    pivots = (F.min("node").alias("p1"), F.max("node").alias("p2"), F.min_by("node", F.xxhash64("node")).alias("p3"))
    sized = materialize(with_groups(postings, "token", F.count(F.lit(1)).alias("size"), *pivots).where("size > 1"), "lists")
    long_lists = sized.where(F.col("size") > hot)
    star = long_lists.select("node", F.explode(F.array("p1", "p2", "p3")).alias("p")).where("node <> p")
    pairs = _pairs_of_short_lists(sized, hot, percent).unionByName(star.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))).distinct()
    side = lambda c: prefixes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("set").alias(f"set_{c}"))
    may = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = materialize(pairs, "candidates").join(side("a"), "a").join(side("b"), "b").where(may)
    edges = materialize(both.mapInArrow(_verify(percent), "a long, b long"), "links")
    labels = materialize(connected_components(edges), "labels")
    # long lists whose members aren't in one component yet
    label = F.coalesce("component", "node").alias("label")
    open_ = materialize(long_lists.select("token", "node").join(labels, "node", "left").select("token", "node", label), "open-lists")
    held = materialize(with_groups(open_, "token", F.min("label").alias("low"), F.max("label").alias("top")).where("low < top").select("node", "label", "low"), "residual")
    if held.isEmpty():
        return labels
    meets = held.where("label <> low").select(F.col("label").alias("a"), F.col("low").alias("b")).distinct()
    clusters = materialize(connected_components(meets).select(F.col("node").alias("label"), F.col("component").alias("cluster")), "clusters")
    members = held.select("node", "label").distinct().join(clusters, "label").join(prefixes, "node")
    keyed = _blocks(materialize(members, "members"), percent)
    found = keyed.groupBy("cluster", "band", "i", "band2", "j").applyInArrow(_verify_block(percent), "a long, b long")
    merged = materialize(connected_components(materialize(found, "block-links")), "merged")
    over = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = labels.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return materialize(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "components")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    chunks = chunk_documents(docs, encode_words, id_col, text_col, name="word-chunks")
    described = materialize(_describe(chunks), "shingle-sets")
    total = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first().n
    # enough bits that few shingles share a counter (which costs time only); the rest of the hash isn't sent
    spare = max(0, 64 - max(40, int(total).bit_length() + 12)) // 8 * 8
    mask = np.uint64((1 << 64) - (1 << spare))
    is_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    headed = materialize(with_groups(described.where(is_set), "digest", F.min(F.struct("doc_id", "chunk", "place")).alias("head")), "classes")
    # a chunk's list of places is bounded by the chunk
    first = headed.where((F.col("head.chunk") == F.col("chunk")) & (F.col("head.place") == F.col("place")))
    by_chunk = first.groupBy("chunk").agg(F.array_join(F.collect_list("place"), ",").cast("binary").alias("counts"))
    places = materialize(by_chunk.select(F.lit(_PLACES).alias("kind"), F.lit(None).cast("long").alias("bucket"), F.col("chunk").alias("node"), "counts"), "places")
    asks = chunks.groupBy("chunk").cogroup(places.groupBy("node")).applyInArrow(_ask(mask), ASK_DDL)
    found = look_up(asks, chunks.count(), _clipped, 4).where("node is not null").select("kind", "bucket", "node", "counts")
    answers = materialize(found, "frequencies")
    both = chunks.groupBy("chunk").cogroup(answers.unionByName(places).groupBy("node"))
    prefixes = materialize(both.applyInArrow(_prefixes(mask, percent), _PREFIX_DDL), "prefixes")
    discard(chunks, answers, places)
    components = link_labels(prefixes, hot, percent)
    discard(prefixes)
    of_class = headed.select("doc_id", "n_shingles", F.col("head.doc_id").alias("node")).join(components, "node", "left")
    rest = described.where(~is_set).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return of_class.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")).unionByName(rest)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: that with the smallest id. Rows without id stay.

    Where ids repeat, each row is a document of its own: rows are numbered by id and text, and the smallest number stays.
    """
    key, number = fresh(docs.columns, "goes_id", "row_number")
    ids = docs.select(F.col(id_col).cast("long").alias("i")).where("i is not null")
    of = id_col
    if not ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        ranges, order = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), [F.col(id_col).cast("long"), F.xxhash64(text_col)]
        sorted_ = docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        docs, of = materialize(sorted_.withColumn(number, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "numbered"), number
    goes = jaccard_components(docs, of, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(goes, F.col(of) == F.col(key), "left_anti").drop(number)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


#: The sets, their links and the smallest reachable id, by SQL on whole tables.
OP8_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2
"""
