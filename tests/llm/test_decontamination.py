import random
import re
from collections import Counter

import pytest

from tarnlake.llm import decontamination as dc


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    weight = {g: sum(map(len, g)) for g in a | b}
    return sum(weight[g] * n for g, n in (a & b).items()) / sum(weight[g] * n for g, n in (a | b).items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def brute(docs, items, limit=0.8):
    out = {}
    for d, text in docs:
        w = split(text)
        have = set(grams(w))
        for i, item in items:
            v = split(item)
            g = grams(v)
            if g and have & set(g):
                n = min(len(v), len(w))
                best = max(similarity(grams(w[s : s + n]), g) for s in range(len(w) - n + 1))
                if best >= limit:
                    out[d, i] = best
    return out


def got(df):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


@pytest.mark.parametrize("block", [dc.ITEMS, 150], ids=["one block", "blocks"])
def test_equals_brute_force(spark, block):
    r = random.Random(4)
    word = lambda: r.choice("bcdfghjkl") * r.randrange(1, 4) + r.choice("aeiou") + str(r.randrange(30))
    items = [(i, " ".join(word() for _ in range(r.randrange(3, 60)))) for i in range(30)] + [(None, "x"), (31, None), (32, "")]
    docs = [(0, None), (1, ""), (2, "  ")]
    for d in range(3, 120):
        w = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            v = r.choice(items[:30])[1].upper().split()
            for _ in range(r.choice([0, 0, 1, 2])):
                k = r.randrange(len(v))
                v[k : k + 1] = r.choice([[], ["new"], [v[k], "new"]])
            k = r.randrange(len(w) + 1)
            w[k:k] = v
        docs.append((d, "\n".join(w)))
    df = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item string, m int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want, have = brute(docs, items), got(dc.contaminated(df, bench, block=block))
    assert have.keys() <= want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in have)
    # The radius leaves a small chance of missing what is barely similar.
    assert all(want[k] < 0.85 for k in want.keys() - have.keys()) and len(have) >= 0.99 * len(want) > 20
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_long_words_at_the_threshold(spark):
    """Every window from 0.8 on is found, also where few shingles hold most of the weight."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("bcdfghjklaeiou0123456789") for _ in range(n))
    items, docs = [], []
    for i in range(40):
        v = [word(r.randrange(2, 9)) for _ in range(r.randrange(40, 160))]
        for _ in range(r.randrange(1, 4)):
            v[r.randrange(len(v))] = word(r.randrange(40, 250))
        if i % 4 == 0:
            v[20:20] = v[:12] * 2
        items.append((i, " ".join(v)))
        tries = 0
        while len(docs) < 15 * (i + 1) and (tries := tries + 1) < 3000:
            w = list(v)
            for _ in range(r.randrange(1, 5)):
                k = max(range(len(w)), key=lambda k: len(w[k])) if r.random() < 0.3 else r.randrange(len(w))
                w[k : k + 1] = r.choice([[word(5)], [word(5)], [], [w[k], word(4)], [word(60)]])
            if 0.8 <= similarity(grams(w), grams(v)) < 0.85:
                docs.append((len(docs), " ".join([word(4) for _ in range(r.randrange(4))] + w + [word(4) for _ in range(r.randrange(4))])))
    want = brute(docs, items)
    have = got(dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")))
    assert len(want) > 300 and have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in have)


def test_repeated_shingles_count_as_often_as_in_the_item(spark):
    line = "one two three four five six"
    items = [(1, f"{line} " * 3 + "seven eight nine"), (2, "x " * 9), (3, f"{line} zero ten eleven twelve dozen")]
    docs = [(1, f"{line} " * 40), (2, "x " * 7), (3, "x " * 300), (4, f"a b {line} " + f"{line} " * 2 + "seven eight nine"), (5, f"{line} {line} {line} seven eight"), (6, "x " * 8 + "y " * 8)]
    want = brute(docs, items, 0.4)
    have = got(dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), similarity=0.4))
    assert len(want) > 4 and have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in have)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    have = got(dc.contaminated(docs, bench))
    assert want and have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in have)


def test_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (8, "one two three four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text), (1, text)], "item_id long, text string")
    rows = dc.contaminated(docs, bench).collect()
    assert len(rows) == 6 and {r["doc_id"] for r in rows} == {None, 7} and {r["similarity"] for r in rows} == {1.0}
