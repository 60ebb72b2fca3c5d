"""Whitening, exact search and fill-in-middle against plain Python, numpy and SQL."""

import hashlib
import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_search, fill_in_middle, queries, whitening

DATA = Path("/root/testdata/sf0.001")
DDL = "vec_id long, embedding array<float>, n long, d int, part int, component int"


def vectors(count=300, d=6, seed=1):
    """Tied, repeated, null, empty, short and non-finite vectors; null and repeated ids."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(y) for y in np.round(rng.normal(size=d) * rng.uniform(0.2, 2, d), 2)]) for i in range(count)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(60)]  # copies
    rows += [(2000, None), (2020, []), (2021, []), (2040, [1.0] * (d - 1)), (2041, [0.5] * (d - 1)), (2060, [1.0, None, *[0.0] * (d - 2)]), (2080, [math.nan] * d), (2100, [math.inf] * d)]
    rows += [(None, rows[0][1]), (None, rows[20][1]), (20, rows[5][1]), (20, rows[5][1]), (2120, [0.0] * d)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, 7, 7) for i, v in rows], DDL).repartition(3)


def finite(rows):
    return [(i, [float(np.float32(y)) for y in v]) for i, v in rows if v is not None and all(y is not None and math.isfinite(y) for y in v)]


# --- exact search ---


def brute_top(rows, k, every):
    """Sorted (query id, rank, id, score), by all pairs."""
    x = [(i, [math.floor(64 * y) for y in v]) for i, v in finite(rows)]
    out = []
    for a, (i, q) in enumerate(x):
        if i is None or i % every:
            continue
        found = [(-sum(p * r for p, r in zip(q, v, strict=True)), j is None, j or 0) for b, (j, v) in enumerate(x) if a != b and len(v) == len(q)]
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,group,lane", [(4096, 32768, 2048), (16, 5, 40)])
def test_exact_search_against_all_pairs(spark, monkeypatch, block, group, lane):
    for name, value in (("BLOCK", block), ("GROUP", group), ("LANE", lane)):
        monkeypatch.setattr(exact_search, name, value)
    rows = vectors()
    got = exact_search.exact_top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 20, 20)
    few = rows[:7]
    got = exact_search.exact_top_k(frame(spark, few), F.col("vec_id") % 3 == 0, 20)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(few, 20, 3)


def test_exact_search_without_rows(spark):
    assert exact_search.exact_top_k(frame(spark, vectors()).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_search.exact_top_k(frame(spark, [(1, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_search.exact_top_k(frame(spark, [(20, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-60, 60, (500, 7)), np.zeros((9, 3), int), rng.integers(0, 2, (40, 5)), rng.integers(-(2**28), 2**28, (300, 4))):
        cells, low, high = exact_search.quantised(x)
        assert (exact_search.unpacked(exact_search.packed(cells), *x.shape) == cells).all()
        entry = np.arange(x.shape[1])
        assert (low[entry, cells] <= x).all() and (x <= high[entry, cells]).all()


@pytest.mark.parametrize("top", [30, 2**20, 2**27])
def test_blocks_of_large_numbers(top):
    """float32, float64 and bounds with slack give the same exact scores."""
    rng = np.random.default_rng(3)
    x, q = rng.integers(-top, top, (700, 8)), rng.integers(-top, top, (30, 8))
    asked = exact_search._Asked(5, np.full(30, -1), np.zeros(30, int), np.arange(30), q)
    for part in np.array_split(np.arange(700), 3):
        cells, low, high = exact_search.quantised(x[part])
        entry = np.arange(8)
        exact_search.search_block(asked, exact_search._Block(1, part, np.zeros(len(part), bool), x[part], low[entry, cells], high[entry, cells]))
    want = np.array([sorted(((int(a @ b), -k) for k, b in enumerate(x)), reverse=True)[:5] for a in q])
    assert (asked.score == want[:, :, 0]).all() and (asked.found == -want[:, :, 1]).all()


# --- whitening ---


def brute_whitening(rows, k):
    lengths = [len(v) for _, v in rows]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [(i, v) for i, v in rows if len(v) == d]
    x = [[math.floor(1024 * y) + 100_000 for y in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [[n * y - s for y, s in zip(v, sums, strict=True)] for v in x]
    c = np.array(deviation, float) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [i for i, _ in kept], [sum(y * y for y in v) for v in deviation], c @ basis / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_against_numpy(spark):
    rows = vectors()
    got = whitening.whiten(frame(spark, rows)).orderBy(F.col("vec_id"), "deviation").collect()
    ids, deviation, white, explained = brute_whitening(finite(rows), 8)
    n, d = len(ids), 6
    assert len(got) == n * d and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    for k in range(d):
        own = sorted((r for r in got if r.component == k + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0, deviation[i]))
        assert [(r.vec_id, r.deviation) for r in own] == [(ids[i], deviation[i]) for i in order]
        a, b = np.array([r.whitened for r in own]), white[order, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert own[0].explained == pytest.approx(explained[k], rel=1e-9)


def test_whitening_of_hard_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [math.nan]), (3, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(frame(spark, [(k, [k / 4, 1.0]) for k in range(9)])).collect()  # the second entry never varies
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and max(r.identity_error for r in flat) < 1e-12
    huge = whitening.whiten(frame(spark, [(k, [3e38 * (k % 2), float(k)]) for k in range(9)])).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 18


def test_whitening_of_large_counts():
    """Deviations beyond 64 bits are exact in Python's integers."""
    centre = whitening.Centring(10**15, [10**20 + 7, 3], 1024.0, 0)
    assert centre.deviations(np.array([[100.5, -1.0]])).tolist() == [[10**15 * 102912 - 10**20 - 7, -1024 * 10**15 - 3]]


# --- fill-in-middle ---

TEXTS = ["a\nb\nc", "", None, "one line", "\n\n\n", "x\r\ny z\n", "has <P> inside\nb", "<S", "<", "ends <\n<S\n<M", "日本\nÜ🙂\n", "l\n" * 50_000, "w" * 300_000]


def plain_form(text, key, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    a, b, c, e = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return len(units), "plain", None, None, t
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if e % 100 < spm:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle_against_plain_python(spark, rate):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(60)] + [(None, "a\nb"), (None, None), (3, "other\ntext"), (2**62 + 1, "p\nq\nr")]
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], "doc_id long, text string, output string, form string").repartition(3)
    made = fill_in_middle.fill_in_middle(df, rate=rate).withColumn("back", fill_in_middle.restored()).collect()
    want = [(i, *plain_form(t, "" if i is None else i, rate), t or "") for i, t in rows]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back.text) for r in made]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.back.text_sha256 == hashlib.sha256(r.back.text.encode()).hexdigest() for r in made)
    assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0


def test_rebuilt_inverts_arrange():
    r, unit = random.Random(4), fill_in_middle.regex.compile(fill_in_middle.UNIT)
    for k in range(3000):
        text = "".join(r.choice(["<", "P", ">", "S", "M", "\n", "a", "é", "\r"]) for _ in range(r.randrange(30)))
        n, form, p, m, out = fill_in_middle.arrange(text, str(k), "7", 100, 50, unit)
        assert fill_in_middle.rebuilt(out, form) == text and (n, form, p, m, out) == plain_form(text, k)


# --- the queries ---


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_exact_search"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    ids, deviation, white, explained = brute_whitening(finite(rows), 8)
    got = whitening.op11_whitening(spark, str(DATA)).collect()
    place = {i: k for k, i in enumerate(ids)}
    assert len(got) == 8 * len(ids) and max(r.identity_error for r in got) < 1e-9
    a = np.zeros((len(ids), 8))
    for r in got:
        a[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert np.abs(np.abs((a * white).mean(0)) - 1).max() < 1e-6
