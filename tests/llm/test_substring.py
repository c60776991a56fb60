import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import substring_dedup as sd


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def corpus(seed, docs, alphabet="abcd é\n\0", passages=6):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [text(r.randrange(10, 90)) for _ in range(passages)]
    out = [None, "", "short", "a" * 150, "ab" * 60, "a" * 30]
    for _ in range(docs):
        out.append("".join(r.choice([text(r.randrange(40)), r.choice(shared), r.choice(shared)[: r.randrange(1, 90)]]) for _ in range(r.randrange(6))))
    return [*out, out[-1], out[-1], out[3]]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="ab\0é", max_size=60), min_size=1, max_size=6), st.integers(2, 9))
def test_index_equals_brute_force(texts, length):
    parts = []
    for t in texts:
        parts += [*(b + 1 for b in t.encode()), 0]
    codes = np.array(parts, np.int64)
    got = sd.repeated_places(codes, length)
    grams = [tuple(parts[i : i + length]) for i in range(len(parts))]
    valid = [len(g) == length and 0 not in g for g in grams]
    seen = Counter(g for g, v in zip(grams, valid) if v)
    for i, v in enumerate(valid):
        if v:
            assert got[i] == (seen[grams[i]] > 1), (i, codes)


@pytest.mark.parametrize("crowd", [3000, 3], ids=["indexed", "crowded"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, crowd):
    texts = corpus(seed, 120)
    rows = [(None if i % 11 == 0 else i // 2, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, low string").coalesce(2)
    got = sorted(result(sd.remove_repeats(df, length=25, gram=7, crowd=crowd)))
    assert got == sorted(brute(texts, 25))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 400)))
    got = sd.remove_repeats(docs, with_text=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert any(r["n_removed"] for r in got) and all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, "y" * 399)], "doc_id long, text string")
    assert sorted(r[:3] for r in result(sd.remove_repeats(df))) == [(399, 0, 0), (500, 500, 1)]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_pieces_of_a_long_text_find_every_window():
    r = np.random.default_rng(1)
    raw = r.integers(97, 100, 5 * sd.SLAB).astype(np.uint8)
    seen = []
    for _, skip, part, bounds in sd._pieces(raw, np.array([0, len(raw)]), 400):
        _, start, n, *_ = sd.segments(part, bounds)
        seen += [(s + skip, s + skip + k) for s, k in zip(start.tolist(), n.tolist())]
    assert seen[0][0] == 0 and seen[-1][1] == len(raw) - 399 and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
