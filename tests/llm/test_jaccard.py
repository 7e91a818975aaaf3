"""The Jaccard join, against all pairs."""

import random

import pytest

from brindle.llm import components, jaccard, minhash

SCHEMA = "doc_id long, text string, v long, label string, g int, token long, n int"


def texts(seed, docs=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = say(60)
    out = []
    for i in range(docs):
        base = say(r.choice([3, 5, 12, 40, 120, 300]))
        out.append(base)
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            near = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                near[r.randrange(len(near))] = r.choice(vocab)
            out.append(near + say(r.choice([0, 0, 1, 3])))
        if i % 3 == 0:
            out.append(passage + say(r.choice([0, 2, 4, 6, 8, 30])))
    # A template below and around the threshold, and a chain whose ends are not alike.
    base = say(200)
    out += [[w if j % 25 != 7 else f"x{i}y{j}" for j, w in enumerate(base)] for i in range(40)]
    out += [[w if j % 70 != 7 else f"x{i}y{j}" for j, w in enumerate(base)] for i in range(40)]
    chain = say(100)
    out += [chain[k : k + 90] for k in range(0, 11)]
    out = [" ".join(t) for t in out]
    out += [out[0]] * 30 + [out[1].upper(), out[2].replace(" ", " \n "), None, "", " \t", "one", "One", "two words", "two  words", "ü€ ü€ ü€ ü€", " ".join(say(20_000))]
    return out


def shingle_set(text, n=4):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def expected(rows, percent=85, n=4):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((root(i), root(j)))
                    up[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize(("seed", "percent", "members"), [(1, 85, 32), (2, 85, 2), (3, 70, 4)])
def test_all_pairs(spark, monkeypatch, seed, percent, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    t = texts(seed)
    ids = random.Random(seed).sample(range(10 * len(t)), len(t))
    rows = list(zip(ids, t, strict=True))
    docs = spark.createDataFrame([(i, x, 1, "x", 2, 3, 4) for i, x in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in jaccard.similar(docs, percent=percent).collect())
    assert got == expected(rows, percent)


def test_first_ngrams_suffice():
    """Any two sets of enough similarity share one of those that they show, in any order."""
    r = random.Random(4)
    for _ in range(3000):
        percent = r.choice([70, 80, 85, 95])
        n = r.randint(1, 60)
        x = set(r.sample(range(100), n))
        y = set(x)
        for _ in range(r.randint(0, 8)):
            (y.discard if r.random() < 0.5 else y.add)(r.randrange(100))
        both = len(x & y)
        if y and 100 * both >= percent * (len(x) + len(y) - both):
            x, y = sorted((x, y), key=len)
            small, large = sorted(x)[: jaccard.firsts(len(x), percent)[0]], sorted(y)[: jaccard.firsts(len(y), percent)[1]]
            assert set(small) & set(large)


def test_bitmaps_never_exceed():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(300):
        x, y = (r.choice(2**62, k, replace=False).astype(np.uint64) for k in r.integers(1, 400, 2))
        y = np.unique(np.append(y, x[: len(x) // 2]))
        x = np.unique(x)
        assert jaccard.apart(jaccard.parity(x), jaccard.parity(y)) <= len(np.setxor1d(x, y))


def test_nulls_repeats_empty(spark):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u"), (9, "q r s t u"), (9, "q r s t u")]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs).collect() if r.doc_id is not None)
    assert got == [(3, 3, 3), (5, 3, 3), (7, 2, 3), (7, 3, 3), (9, 2, 3), (9, 2, 3)]
    assert sum(r.doc_id is None and r.component_id is None for r in jaccard.similar(docs).collect()) == 2
    assert jaccard.similar(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("module, run", [(jaccard, lambda d: jaccard.similar(d)), (minhash, lambda d: minhash.near_duplicates(d, ngram=2))])
def test_growing_tables_are_not_broadcast(spark, monkeypatch, module, run):
    """However small the tables, only bitmaps of bounded size are broadcast: what goes through the driver does not grow with the input."""
    plans = []

    def table(df, *a, made=module.table, **k):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return made(df, *a, **k)

    for m in (module, components):
        monkeypatch.setattr(m, "table", table)
    base = [f"w{i} x{i % 7} y{i % 5} z{i % 3}" for i in range(60)]
    rows = [(i, " ".join(base[i % 5 :][:50]) + f" end{i}") for i in range(40)]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(plans) > 10 and all("_page" in line for line in joins), joins
