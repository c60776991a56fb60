import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnlake.llm import jaccard_join as jj


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, t=85, k=4):
    """{doc_id: (set size, smallest reachable doc_id)} by comparing all sets that share a shingle."""
    sets = {i: shingles(x, k) for i, x in rows}
    where = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in sets.items():
        for j in set().union(*(where[g] for g in s)) if s else ():
            if j < i and find(i) != find(j):
                o = len(s & sets[j])
                if 100 * o >= t * (len(s) + len(sets[j]) - o):
                    a, b = sorted((find(i), find(j)))
                    up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family(r, base, edits, copies):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(r.randrange(edits + 1)):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1, 1])] = [r.choice("abcdefgh") * r.randrange(1, 9)] * r.choice([1, 1, 0, 2])
            w = w or ["x"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    r = random.Random(seed)
    texts = [None, "", " \n", "One", "one", "one two three", "one two three four", "ONE two three four"]
    for size in (4, 6, 9, 12, 15, 17, 20, 22, 24, 27, 40, 90, 300):
        base = " ".join(r.choice("klmnopqrst") + str(r.randrange(500)) for _ in range(size))
        texts += family(r, base, max(2, size // 12), 25)
    texts += texts[-3:] * 4
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jj.join_components(df)) == brute(rows)
    if seed == 1:
        assert got(jj.join_components(df, words=5, t=80)) == brute(rows, 80, 5)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(jj.join_components(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("least", [3, 40])
def test_frequent_shingles(spark, monkeypatch, least):
    monkeypatch.setattr(jj, "FREQUENT_LEAST", least)
    r = random.Random(9)
    common = " ".join(f"c{i}" for i in range(40))
    base = " ".join(r.choice("klmnopqrst") + str(r.randrange(500)) for _ in range(60))
    texts = [f"{' '.join(str(r.randrange(10**6)) for _ in range(r.randrange(30)))} {common}" for _ in range(120)]
    texts += family(r, common + " " + base, 4, 60) + [common] * 30
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jj.join_components(df)) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (3, None), (9, "p q r s t"), (9, "a b c d e")]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, n int, token string")
    out = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in jj.join_components(df).collect())
    assert out == [(-1, 2, None), (-1, 2, None), (3, 0, 3), (5, 2, 5), (5, 2, 5), (9, 2, 5), (9, 2, 9)]
    assert jj.join_components(df.limit(0)).count() == 0


def test_light_bound_and_overlap():
    for m in range(1, 60):
        for n in range(1, 60):
            o = jj.need(m, n)
            assert 100 * o >= 85 * (m + n - o) and 100 * (o - 1) < 85 * (m + n - o + 1)
    assert jj.choose_light({5: 1000, 18: 10}, 2.0) <= jj.choose_light({5: 1000, 18: 10}, 1e6)
    keys = jj.light_keys(18)
    assert all(c <= low <= 18 <= high or low <= high == 18 for low, high, c in keys)


def test_sets_do_not_depend_on_the_slab():
    texts = ["a b c d e f", "x", "", "a b c d e f"]
    bs = [t.encode() for t in texts]
    raw, bounds = np.frombuffer(b"".join(bs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bs])])
    g, ends = jj.shingle_sets(raw, bounds)
    k = jj.set_keys(g, ends)
    assert k[0] == k[3] and k[2] == 0 and np.diff(ends).tolist() == [3, 1, 0, 3]


def test_what_is_sent_stays_small_with_many_ranges():
    """With a range to each few shingles, as over many gigabytes, every shingle has a class's key beside it."""
    r = random.Random(4)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(300)) for _ in range(60)]
    texts += family(r, texts[0], 3, 5)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    ranges, none = 9000, np.zeros(0, np.uint64)
    sample = list(jj._sampled(4, 85, ranges, none)([batch]))
    able = {h for x in jj._enough(jj._sharing(ranges)(sample)) for h in x.column("h").to_pylist()}
    g, ends = jj.shingle_sets(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    keys = jj.set_keys(g, ends).tolist()
    assert able == {keys[0], *keys[60:]}
    bits = 32768
    bloom = np.zeros(bits, np.uint8)
    bloom[jj._places(np.array(sorted(able)), bits).ravel()] = 1
    bloom = np.packbits(bloom, bitorder="little")
    assert jj._among(bloom, np.array(keys)).tolist() == [k in able for k in keys]
    blocks = list(jj._blocks(4, ranges, none, bloom)([batch]))
    size = sum(len(x or b"") for b in sample + blocks for c in b.columns[1:] for x in c.to_pylist())
    assert size < 10 * len(g)


def test_filter_keeps_all_keys(spark):
    keys = [(x * 7919 - 10**6) * 10**11 for x in range(5000)]
    bloom = jj._bloom(spark.createDataFrame([(k,) for k in keys], "h long"))
    assert jj._among(bloom, np.array(keys)).all() and jj._among(bloom, np.array(keys) + 1).mean() < 0.03
