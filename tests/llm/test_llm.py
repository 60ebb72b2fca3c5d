"""The training-data operators on small tables: brute force, round trips, and the hard rows (nulls, empty, long, tied, repeated)."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, common, components, exact_dedup, exchange, jaccard_join, language_model, media, packing, queries, suffix_dedup, token_store, toxicity
from docloom.llm.common import tokenizer_path

DATA = Path("/root/testdata/sf0.001")
DDL = "doc_id long, text string, lang string, source string, n_chars long, __id string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, short, blank, null, very long, accented and repeated rows."""
    base, passage = prose(1, 200), prose(2, 60)
    texts = [base, base, base + " end", " ".join([*base.split()[:100], "changed", *base.split()[101:]]), prose(3, 150), prose(4, 40) + " " + passage + " " + prose(5, 30)]
    texts += [passage + " " + prose(6, 50), None, "", "   ", "one two", "ONE  two", "Ünïcödé 日本 <|im_end|> <|endoftext|> don't", "a" * 3000, prose(7, 4000), "x\ty\nz\r\n  q", passage, base.upper()]
    for k in range(12):  # a group of near copies
        w = prose(8, 120).split()
        w[k * 7] = f"edit{k}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- exact dedup ---


def test_exact_dedup(spark, docs, empty):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "c"), (None, "c"), (6, "c"), (7, "d"), (7, "d")] + [(100 + i, "hot") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    known = {r[0]: r[1:] for r in con.execute(exact_dedup.OP2_SQL.replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, text FROM documents)")).fetchall() if r[0] is not None}
    for k in (1, 1000):  # without and with room for the hot digest
        got = exact_dedup.exact_dedup(df, heavy=k, tracked=max(16, k)).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got if r.doc_id is not None} == known
        assert {(r.keep_id, r.kept) for r in got if r.doc_id is None} == {(6, False)}
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs.union(docs))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({max(x[0] for x in corpus() if (x[1] or "") == (t or "")) for _, t, *_ in corpus()})
    assert exact_dedup.drop_exact_duplicates(spark.createDataFrame([(None, "p"), (None, "q"), (None, "q")], "doc_id long, text string")).count() == 2


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- tokens ---


def test_bpe_equals_the_library(docs, path, library, empty):
    got = by_id(bpe.round_trip(docs, path))
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = by_id(bpe.decode_documents(bpe.encode_documents(docs, path), path))
    assert all(texts[i].text == (t or "") for i, t, *_ in corpus())
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_on_random_texts(path, library):
    r = random.Random(5)
    signs = ["a", " ", "\n", "'s", "'", "ll", "é", "日", "1", "🙂", " ", "<|endoftext|>", "\x00", "the", "ing", "́"]
    own, lib = bpe.BPE(path), bpe.LibraryBPE(path)
    for _ in range(500):
        t = "".join(r.choice(signs) for _ in range(r.randrange(25)))
        ids = struct.pack("<%dI" % len(x := library.encode(t, add_special_tokens=False).ids), *x)
        assert own.encode(t) == ids == lib.encode(t)
        assert own.decode(ids) == t


def test_every_sign_is_cut_as_in_the_library(library):
    """All code points, beside letters, numbers, other signs and blanks."""
    cut = library.pre_tokenizer.pre_tokenize_str
    other = []
    for c in (c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF):
        s = f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}"
        if [len(x) for x in bpe.pretokens(s)] != [b - a for _, (a, b) in cut(s)]:
            other.append(c)
    assert other == []


def test_signs_of_newer_tables(path, library):
    r = random.Random(6)
    newer = [chr(r.randint(a, b)) for a, b in bpe.NEWER + bpe.NEWER_BEYOND]
    own, lib = bpe.BPE(path), bpe.LibraryBPE(path)
    for _ in range(1500):
        t = "".join(r.choice((r.choice(newer), "'ll", " ", "a", "1", "日", "!", "\n", "é")) for _ in range(r.randrange(12)))
        ids = struct.pack("<%dI" % len(x := library.encode(t, add_special_tokens=False).ids), *x)
        assert own.encode(t) == ids == lib.encode(t) and own.decode(ids) == t


def test_token_files(spark, docs, path, library, empty, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"), path, block_tokens=700)
    got = by_id(token_store.read_tokens(spark, str(tmp_path / "t")))
    at = 0
    for i, t, *_ in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert list(np.frombuffer(got[i].ids, "<u4")) == ids
        at += len(ids)
    assert spark.read.parquet(str(tmp_path / "t/blocks")).count() > 3
    token_store.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_blocks_decode_in_parts_and_notice_damage():
    ids = np.random.default_rng(0).zipf(1.3, 200_000) % 5000
    tokens, counts = np.unique(ids, return_counts=True)
    table = token_store.FrequencyTable.of_counts(tokens, counts)
    data = token_store.encode_block(ids, table)
    assert (token_store.decode_block(data, table) == ids).all()
    size = token_store.LANES * token_store.CHECKPOINT_STEPS
    assert (token_store.decode_block(data, table, 1, 2) == ids[size : 2 * size]).all()
    with pytest.raises(ValueError, match="damaged"):
        token_store.decode_block(data[:-400] + bytes(400), table)
    assert len(data) < 2 * len(ids)


# --- packing ---


def check_packing(rows, lengths, capacity=1024):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= capacity
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for doc, n in lengths.items():
        own = sorted(pieces[doc])
        assert [p for p, *_ in own] == list(range(len(own)))
        assert sum(x for *_, x in own) == n and own[0][1] == 0
        assert all(length == capacity for _, _, length in own[1:])
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
    return len(places)


def test_packing(docs, path, library, empty):
    packed = packing.pack_documents(docs, path, with_ids=True)
    rows = packed.collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in corpus()}
    n = check_packing(rows, {i: len(x) for i, x in ids.items()})
    assert n <= -(-sum(map(len, ids.values())) // 1024) + 2
    for r in rows:
        own = struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length])
        assert own == r.ids and zlib.crc32(own) == r.ids_crc32
    assert all(len(r.ids) <= 4096 for r in packing.packed_sequences(packed).collect())
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("kind", ["small", "large", "mixed", "one", "two", "few", "none"])
def test_plans_cover_and_fit(kind):
    """Every item once, nothing too long, never more sequences than best-fit decreasing alone, never fewer than the bound."""
    rng = np.random.default_rng(3)
    few = [130, 201, 257, 300, 333, 402, 455, 511, 600, 700, 801]
    x = {"small": rng.integers(1, 60, 5000), "large": rng.integers(400, 1025, 3000), "mixed": np.clip(rng.lognormal(5.5, 1, 20000).astype(int) + 1, 1, 1024)}
    x |= {"one": np.full(1000, 300), "two": np.array([5, 1024, 7]), "few": rng.choice(few, 50_000), "none": np.zeros(0, int)}
    lengths, counts = np.unique(x[kind], return_counts=True)
    plan = packing.plan_sequences(lengths, counts, rounds=200)
    got = Counter()
    for config, times in plan.sequences:
        assert sum(n * c for n, c in config) <= 1024 and times > 0
        for n, c in config:
            got[n] += c * times
    known = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert got == Counter(known)
    alone = packing.best_fit_decreasing(known, 1024)
    assert sum(int(n) * c for n, c in known.items()) / 1024 - 1e-6 <= plan.bound <= plan.count + 1e-6 <= sum(t for _, t in alone) + 1e-6
    if kind == "few":  # where configurations matter, the program decides, and gets near the bound
        assert plan.from_program > 0.9 * plan.count and plan.count <= 1.006 * plan.bound
        assert plan.count < 0.995 * sum(t for _, t in alone)


def test_the_covering_program():
    """Its cover is feasible and not below its bound; a hand-made case where both are known: 500s and 524s fit in pairs."""
    program = packing.CoveringProgram(np.array([300, 500, 524]), np.array([30, 100, 100]), 1024)
    program.run(60)
    covered = Counter()
    for config, share in program.shares:
        assert sum(n * c for n, c in config) <= 1024
        for n, c in config:
            covered[n] += c * share
    assert all(covered[n] >= d - 1e-6 for n, d in ((300, 30), (500, 100), (524, 100)))
    assert 110 - 1e-6 >= program.bound and program.value >= program.bound - 1e-6 and program.value <= 110 * 1.02


# --- suffix dedup ---


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if k in seen:
                gone[s : s + 100] = True
            seen.add(k)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, empty):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_repeats([(i, t) for i, t, *_ in corpus()])
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    r = random.Random(1)
    tricky = [(k, "".join(r.choice("ab") for _ in range(r.randrange(1, 8))) * r.randrange(1, 80)) for k in range(60)] + [(100 + k, "日本語" * k) for k in range(30)] + [(200 + k, chr(0) * k * 20) for k in range(10)]
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(spark.createDataFrame(tricky, "doc_id long, text string")).collect()}
    assert got == brute_repeats(tricky)
    hot = suffix_dedup.suffix_dedup(spark.createDataFrame(tricky, "doc_id long, text string"), hot_gram=1)  # all repeated grams are split
    assert {x.doc_id: tuple(x)[1:] for x in hot.collect()} == got
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert by_id(cut)[7].text is None


def test_repeated_and_null_ids_lose_nothing_else(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage, own = words(40), {k: words(30) for k in "abcdefgt"}
    rows = [(i, f"{own[k]} {passage}", k) for i, k in ((1, "a"), (5, "b"), (5, "c"), (None, "d"), (None, "e"))] + [(5, own["f"], "f"), (9, own["t"], "t"), (9, own["t"], "u"), (None, None, "n")]
    got = {x.tag: x.text for x in suffix_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect()}
    assert len(got) == len(rows) and got["n"] is None and got["f"] == own["f"]
    assert all(got[k].startswith(own[k][:200]) for k in "abcde")
    assert sum(passage in got[k] for k in "abcde") == 1
    assert sorted((got["t"], got["u"])) == ["", own["t"]]
    near = [(1, passage, "a"), (5, f"{passage} x", "b"), (5, own["c"], "c"), (None, passage, "d"), (7, own["g"], "e"), (7, own["g"], "f")]
    kept = jaccard_join.drop_near_duplicates(spark.createDataFrame(near, "doc_id long, text string, tag string"))
    assert kept.columns == ["doc_id", "text", "tag"]
    tags = sorted(x.tag for x in kept.collect())
    assert tags in (["a", "c", "d", "e"], ["a", "c", "d", "f"])


def test_deep_shallow_sort():
    rng = np.random.default_rng(2)
    for n, alphabet in ((1, 2), (300, 2), (500, 3)):
        texts = rng.integers(97, 97 + alphabet, (n, 100)).astype(np.uint8)
        texts[: n // 2, :90] = texts[0, :90]  # long common prefixes
        gram = rng.integers(0, 3, n).astype(np.uint64)
        order, common = suffix_dedup.deep_shallow_sort(gram, texts)
        keys = [(int(gram[i]), texts[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, n):
            a, b = keys[k - 1], keys[k]
            want = -1 if a[0] != b[0] else next((i for i in range(100) if a[1][i] != b[1][i]), 100)
            assert common[k] == want


# --- near duplicates ---


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("hot", [2, 48])
def test_jaccard_components(docs, empty, hot):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, hot=hot).collect()}
    assert got == brute_components([(i, t) for i, t, *_ in corpus()])
    assert jaccard_join.jaccard_components(empty, hot=hot).count() == 0


def test_jaccard_blocks_of_a_hot_group(spark, monkeypatch):
    base = prose(9, 100).split()
    r = random.Random(4)
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(100)] = f"e{r.randrange(1000)}"
        rows.append((k, " ".join(w)))
    for k in range(90, 150):  # lengths and components of their own around the same words
        own = prose(k // 3, 30 + k)
        rows.append((k, " ".join(base[: 40 + k % 50]) + " " + own))
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 16)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hot=4).collect()}
    assert got == brute_components(rows)


def test_jaccard_sql_says_the_same(spark, docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t, *_ in corpus()], columns=["doc_id", "text"]))
    want = {r[0]: r[1:] for r in con.execute(jaccard_join.OP8_SQL).fetchall()}
    assert want == brute_components([(i, t) for i, t, *_ in corpus()])


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- chat ---


def test_chat(spark, path):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b <|x|> <\\| <\\\\|"), (1, 0, "user", said), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 3, None, "n"), (3, 5, "system", "é" * 500), (1, 2, "assistant", "last\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns, path), path).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for t in ("", "<|", "<\\|", "<\\\\|<|im_start|>", "a|b<c"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    assert chat.read_back(chat.format_turns(turns.limit(0), path), path).count() == 0


# --- scoring ---


def brute_scores(toks, held):
    """Deleted interpolation in plain Python: counts in dictionaries, every event on its own in the EM, no bins."""
    grams = [(i, x, (["</s>", "</s>", *x][k] if k < 2 else x[k - 2], ["</s>", *x][k], w)) for i, x in toks.items() for k, w in enumerate(x)]
    train = [g for i, _, g in grams if not held[i]]
    c3, c2, c1 = Counter(train), Counter(g[1:] for g in train), Counter(g[2] for g in train)
    x3, x2, n, v = Counter(g[:2] for g in train), Counter(g[1] for g in train), len(train), len(c1)

    def parts(g, less):
        two, one = x3[g[:2]] - less, x2[g[1]] - less
        p = [(c3[g] - less) / two if two > 0 else 0, (c2[g[1:]] - less) / one if one > 0 else 0, (c1[g[2]] - less) / (n - less), 1 / (v + 1)]
        return (1, int(math.log2(two))) if two > 0 else (2, int(math.log2(one))) if one > 0 else (0, 0), np.array(p)

    events = [parts(g, 1) for g in train]
    allowed = {0: [0, 0, 1, 1], 1: [1, 1, 1, 1], 2: [0, 1, 1, 1]}

    def em(p, start, prior):
        a = start.copy()
        for _ in range(60):
            share = p * a
            share /= share.sum(1, keepdims=True)
            a = share.sum(0) + prior * start
            a /= a.sum()
        return a

    pooled, weights = {}, {}
    for kind, may in allowed.items():
        own = [p for (k, _), p in events if k == kind]
        start = np.array(may) / sum(may)
        pooled[kind] = em(np.array(own), start, 1.0) if own else start
        for b in {b for b, _ in events if b[0] == kind}:
            weights[b] = em(np.array([p for x, p in events if x == b]), pooled[kind], 20.0)
    out = dict.fromkeys(toks, 0.0)
    for i, _, g in grams:
        b, p = parts(g, 0)
        out[i] += math.log10(weights.get(b, pooled[b[0]]) @ p)
    return out


def test_language_model(docs, empty):
    got = by_id(language_model.score_documents(docs))
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for i, t, *_ in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    train = Counter(w for i, x in toks.items() if not held[i] for w in x)
    n, v, scores = sum(train.values()), len(train), brute_scores(toks, held)
    for i, x in toks.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(x), sum(train[w] > 0 for w in x), n)
        assert got[i].held_out == held[i]
        assert got[i].base_score == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
        assert got[i].score == pytest.approx(scores[i], rel=0.01, abs=0.01)
    assert language_model.score_documents(empty).count() == 0


def test_a_held_out_copy_scores_high(spark):
    """What occurs in the training rows is likelier than new text of the same words."""
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1}
    rows = [(i, prose(i // 2 if i < 200 else i, 60)) for i in range(400)]  # half of the rows occur twice
    got = by_id(language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    twice = [got[i].score for i in held if i < 200 and i ^ 1 not in held]
    assert min(twice) > max(got[i].score for i in held if i >= 200) + 20


@pytest.mark.parametrize("group", [2, 100])
def test_look_up_by_levels(spark, group):
    """Totals over nodes equal plain sums on every level, in 64 bits, for uneven keys and a key that all nodes share."""
    rng = np.random.default_rng(1)
    hashes = common.mixed(np.arange(1, 200, dtype=np.uint64) * common.MULTIPLIERS[0])
    total, asked, known = Counter(), [], {}
    for node in range(9):
        keys = np.unique(np.append(rng.choice(hashes, 40), hashes[0]))
        counts = np.where(keys == hashes[0], 3_000_000_000, 1)
        known[node] = keys
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            total[k] += c
        asked += exchange.ask_table(5, node, keys, [counts, np.zeros(len(keys), np.int64)], fan=3).to_pylist()
    asks = spark.createDataFrame([tuple(bytes(v) if isinstance(v, bytes) else v for v in r.values()) for r in asked], exchange.ASK_DDL)
    answers = exchange.look_up(asks, 9, lambda t: t, 8, fan=3, group=group).toArrow()
    own = answers.column("node").to_pylist()
    for node, keys in known.items():
        got = exchange.gathered(answers.filter(pa.array([n == node for n in own])), 5, 8)
        assert got[0].tolist() == [total[k] for k in keys.tolist()] and not got[1].any()
    sums = [r["sums"] for r in answers.to_pylist() if r["node"] is None]
    assert np.sum(sums, 0).tolist() == [sum(total.values()), len(total), 0, 0]


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = prose(i, 30) + (" awfulword" if bad else "")
        rows.append((i, text))
        if i // 6 % 2 == 0:  # labels are a fair sample
            labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, prose(1, 20000) + " Awfulwords!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = by_id(toxicity.score(docs, model))
    held = [i for i in range(600) if got[i].held_out]
    assert held and all((got[i].score >= 0.3) == (i % 6 == 0) for i in held)
    assert got[1002].score >= 0.3 and got[1000].score == got[1001].score < 0.3
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 not in {r.doc_id for r in kept.collect()}
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs.limit(5), nothing).count() == 5
    assert toxicity.score(empty, model).count() == 0


# --- media ---


def test_media(spark, docs, empty, tmp_path):
    media.store_texts(docs, str(tmp_path / "m"))
    loaded = media.load_media(spark, str(tmp_path / "m"))
    got = by_id(media.media_features(loaded))
    for i, t, *_ in corpus():
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(b), len(p), hashlib.sha256(p).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(p[-32:])
        assert (got[i].media_bytes, got[i].media_sha256) == (len(m := media.to_png(p)), hashlib.sha256(m).hexdigest())
        assert media.from_png(m) == p
    assert got[0].feature == got[1].feature
    many = spark.read.format("payload_archive").option("rangebytes", 500).load(str(tmp_path / "m"))
    assert sorted(r.key for r in many.collect()) == [i for i, *_ in corpus()]
    media.store_texts(empty, str(tmp_path / "e"))
    assert media.load_media(spark, str(tmp_path / "e")).count() == 0


def test_members_are_retried_and_damage_is_noticed(spark, docs, tmp_path):
    media.store_texts(docs.coalesce(1), str(tmp_path / "m"))
    archive = min((tmp_path / "m").glob("*.arch"))
    data = bytearray(archive.read_bytes())
    data[100] ^= 255
    archive.write_bytes(data)
    with pytest.raises(Exception, match="member at offset 0"):
        spark.read.format("payload_archive").option("retries", 1).load(str(tmp_path / "m")).collect()


# --- queries and pipeline ---


def from_png(data):
    """An independent reader: the signature, chunks by their lengths, zlib, and rows of filter type 0."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, {}
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    assert (depth, colour, rest) == (8, 0, [0, 0, 0]) and b"IEND" in parts
    raw = zlib.decompress(parts[b"IDAT"])
    lines = [raw[k * (width + 1) : (k + 1) * (width + 1)] for k in range(height)]
    assert len(raw) == height * (width + 1) and all(x[0] == 0 for x in lines)
    return b"".join(x[1:] for x in lines)


def brute_feature(p):
    n, mean = len(p), sum(p) / len(p)
    changes, bins = sum(a != b for a, b in zip(p, p[1:], strict=False)), [sum(32 * k <= x < 32 * k + 32 for x in p) for k in range(8)]
    var = sum((x - mean) ** 2 for x in p) / n
    return mean, var, changes * 1000 // n, bins


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_every_query(spark, library):
    """The registered queries over whole tables: SQL where there is some, else the library or plain Python."""
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    results = {}
    for name, query in queries.QUERIES.items():
        got = query(spark, str(DATA))
        if name not in queries.SQL:
            results[name.split("_")[0]] = by_id(got) if name != "op1_best_fit_packing" else got.collect()
            continue
        want = con.execute(queries.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    packed = lambda x: struct.pack(f"<{len(x)}I", *x)
    check_packing(results["op1"], {i: len(x) + 1 for i, x in ids.items()})
    for r in results["op1"]:
        assert r.ids_crc32 == zlib.crc32(packed([*ids[r.doc_id], 2][r.start : r.start + r.length]))
    start, toks = 0, {}
    for i, t in rows:
        b = t.encode()
        assert tuple(results["op3"][i])[1:] == (len(ids[i]), hashlib.sha256(packed(ids[i])).hexdigest(), hashlib.sha256(library.decode(ids[i], skip_special_tokens=False).encode()).hexdigest())
        r = results["op10"][i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[i]) + 1, zlib.crc32(packed([*ids[i], 0])))
        start += len(ids[i]) + 1
        toks[i] = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "</s>"]
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = results["op9"][i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        stored = media.to_png(p)
        assert from_png(stored) == p and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        said = dict(x.split("=") for x in r.feature.split(";"))
        mean, var, changes, bins = brute_feature(p)
        assert int(said["mean"]) == pytest.approx(mean * 1000, abs=1.01) and int(said["var"]) == pytest.approx(var * 1000, abs=1.01)
        assert int(said["changes"]) == changes and said["hist"] == ",".join(map(str, bins))
        r = results["op7"][i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    scores = brute_scores(toks, held)
    assert all(results["op6"][i].score == pytest.approx(scores[i], rel=0.01, abs=0.05) for i in toks)


def test_positive_unlabelled_risk():
    """The weights' descent against a small dense version: same risk, same signs; calibration meets the prior."""
    rng = np.random.default_rng(0)
    has = lambda bad: np.unique(np.concatenate([rng.choice(50, 8), [60, 61][: 2 * bad]]).astype(np.int64))
    positive, unlabelled = [has(1) for _ in range(120)], [has(k % 10 == 0) for k in range(1200)]
    w, b = toxicity.train(positive, unlabelled, 0.1)
    dense = lambda rows: np.array([[f in r for f in range(62)] for r in rows], float)
    x, u, a, c = dense(positive), dense(unlabelled), np.zeros(62), 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(3000):
        zp, zu = x @ a + c, u @ a + c
        if np.logaddexp(0, zu).mean() - 0.1 * np.logaddexp(0, zp).mean() >= 0:
            gp, gu = -0.1 * np.ones(len(zp)) / len(zp), sigmoid(zu) / len(zu)
        else:
            gp, gu = 0.1 * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
        a, c = a - 0.5 * (x.T @ gp + u.T @ gu), c - 0.5 * (gp.sum() + gu.sum())
    raw = np.array([b + w[r].sum() for r in unlabelled])
    bad = np.array([60 in r for r in unlabelled])
    assert raw[bad].min() > raw[~bad].max() and (u @ a + c)[bad].min() > (u @ a + c)[~bad].max()
    scale, shift = toxicity.calibrate(np.array([b + w[r].sum() for r in positive]), raw, 0.1)
    assert sigmoid(scale * raw + shift).mean() == pytest.approx(0.1, abs=0.01)


HARD = [(None, "a b c d e f"), (None, None), (1, "x y z"), (1, "x y z"), (1, "another text here"), (2, ""), (3, " ".join(f"long{k % 977}" for k in range(200_000)))]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op8", "op9", "op10"])
def test_hard_rows(spark, path, tmp_path, name):
    """Null and repeated ids, repeated rows, a text of more than a megabyte, and columns that clash with the operators' own."""
    clash = ", chunk string, node string, bucket string, kind string, ids string, start string, text_sha256 string, n string"
    df = spark.createDataFrame([(*r, *["q"] * 8) for r in HARD], f"doc_id long, text string{clash}").repartition(2)

    def tokens(d):
        token_store.write_tokens(d, f"{tmp_path}/{d.count()}", path)
        return token_store.read_tokens(spark, f"{tmp_path}/{d.count()}")

    def stored(d):
        media.store_texts(d, f"{tmp_path}/{d.count()}")
        return media.media_features(media.load_media(spark, f"{tmp_path}/{d.count()}"))

    run = {
        "op1": lambda d: packing.pack_documents(d, path), "op2": exact_dedup.exact_dedup, "op3": lambda d: bpe.round_trip(d, path), "op4": suffix_dedup.suffix_dedup,
        "op6": language_model.score_documents, "op8": jaccard_join.jaccard_components, "op9": stored, "op10": tokens,
    }[name]
    got = run(df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()).count((False, 1)) == 3
    if name != "op1":
        assert got.count() == len(HARD)
    assert run(df.limit(0)).count() == 0


def test_toxicity_of_hard_rows(spark):
    df = spark.createDataFrame([(*r, "q", "q") for r in HARD], "doc_id long, text string, __id string, slots string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert toxicity.score(df, model).count() == len(HARD)
    assert toxicity.drop_toxic(df, model).columns == df.columns


def test_pipeline_of_hard_rows(spark, tmp_path):
    """Null ids, repeated rows and clashing columns go through all stages; an empty table gives an empty result."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(*r, "en", "s", 1, "q") for r in HARD], "doc_id long, text string, lang string, source string, n_chars long, stay_id string")
    for name, rows in (("full", df), ("none", df.limit(0))):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.materialize(stage(spark, out, str(tmp_path)), "stage")
            assert out.columns == df.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() > 0) == (name == "full")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_pipeline_against_brute_force(spark, path, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = by_id(toxicity.score(docs, model))
    rows = {r.doc_id: r.text or "" for r in docs.collect() if scores[r.doc_id].score < toxicity.THRESHOLD}
    last = {}
    for i, t in rows.items():
        last[t] = max(last.get(t, i), i)
    rows = {i: rows[i] for i in last.values()}
    groups = brute_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    seen, texts = set(), {}
    for i in sorted(rows):
        b = rows[i].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if (k := b[s : s + 100]) in seen:
                gone[s : s + 100] = True
            seen.add(k)
        texts[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert {r.doc_id for r in got} == set(ids)
    check_packing(got, {i: len(x) for i, x in ids.items()})
    for r in got:
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))
    stage = corpus_pipeline.STAGES[3][1](spark, docs, str(DATA))
    assert stage.columns == docs.columns and stage.where(F.col("n_chars") != F.length("text")).count() == 0
