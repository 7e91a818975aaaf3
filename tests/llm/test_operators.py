"""The operators on awkward tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from brindle.llm import chat, exact_dedup, lm, minhash, mixing, packing, quality, sharding, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, id string, label string, position double"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    """Nulls in every column, empty and long texts, ties, copies, near copies and clashing column names."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [say(120) for _ in range(12)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "s0") for i in range(20)]
    out += [(200 + i, base[i % 4].replace(" ", "  \n", 1).replace("a", "A"), "de", None) for i in range(6)]
    out += [(300 + i, base[5] + " " + say(4), "en", "s1") for i in range(5)]
    out += [(400, None, None, None), (401, "", "en", "s0"), (402, " \t\n ", "en", "s2"), (403, "one", "en", "s2"), (404, "One", None, "s2")]
    out += [(500, say(6000), "fr", "s1"), (501, "x" * 5000, "fr", "s1"), (502, "ü€😀 " * 60, "fr", "s1"), (503, "<|endoftext|> hi", "en", "s0")]
    out += [(600, base[7], "en", "s1"), (600, base[7], "en", "s1")]
    return [(i, t, lang, s, None, 1, None, "x", None, 0.5) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nulls(spark):
    """Rows without an identifier, and none at all in the other columns."""
    return spark.createDataFrame([(None, "a b c", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (5, "a b c", None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, nulls, empty):
    got = exact_dedup.exact_duplicates(docs, fan_in=2).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    assert len(got) == len(rows())
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(own), len(own)) and (not r.kept or r.doc_id == min(own))
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(r.kept for r in exact_dedup.exact_duplicates(nulls).collect()) == [False, True, True]
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.drop_exact_copies(nulls).count() == 2 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_merges_sorted_runs_without_further_exchange(spark):
    rows_ = spark.range(100).select(F.col("id"), F.unhex(F.sha2((F.col("id") % 7).cast("string"), 256)).alias("sha"), (F.col("id") % 7).alias("n_bytes"), F.xxhash64(F.col("id") % 7).alias("check"), (F.col("id") % 4).cast("int").alias("run"))
    up = exact_dedup.merged(rows_, 4, 3, F.min(F.struct("id")).alias("best"))
    plan = up._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(run") == plan.count("Exchange ") == 1 and plan.count("Sort [run") == 1 and "SortAggregate" in plan
    assert sorted((r.run, r.best.id) for r in up.collect()) == sorted((run, min(i for i in range(100) if i % 4 == run and i % 7 == k)) for run in range(4) for k in range(7))


def test_mixing(docs, nulls, empty):
    got = mixing.mix_plan(docs).collect()
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    goal, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
            free.discard(s)
    goal |= {s: level * weight[s] for s in free}
    source = {r[0]: r[3] for r in rows()}
    taken = {}
    for r in got:
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-9 for s in order)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert mixing.mix_plan(nulls).count() == 3 and mixing.mix_plan(empty).count() == 0
    mixed = mixing.mixed(docs.where("doc_id <> 600"))
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(words - mixing.mix_plan(docs.where("doc_id <> 600")).agg(F.sum("taken")).first()[0]) == 0


@pytest.fixture(scope="module")
def unnamed(spark):
    """Rows of null ids, of one id on many texts, and equal rows; good texts and short ones."""
    r = random.Random(23)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    good, short = [say(r.randint(80, 300)) for _ in range(60)], [say(20) for _ in range(20)]
    made = [(None if i % 2 else 7, t, "en", f"s{i % 3}") for i, t in enumerate(good + short)] + [(None, good[1], "en", "s1")] * 3
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(3)
    return df, made, good, short


def test_quality_judges_rows_without_identifier_one_by_one(unnamed):
    df, _, good, short = unnamed
    left = [x.text for x in quality.drop_rejected(df).collect()]
    assert not set(left) & set(short) and len(left) >= 58 and left.count(good[1]) in (0, 4)


def test_mixing_plans_rows_without_identifier_one_by_one(unnamed):
    from collections import Counter

    df, made, _, _ = unnamed
    size = Counter()
    for _, t, _, s in made:
        size[s] += len(t.split())
    plan = {x.source_size: int(x.target + 0.5) for x in mixing.mix_plan(df).collect()}
    goal = {s: plan[n] for s, n in size.items()}
    taken, times = Counter(), Counter()
    for x in mixing.mixed(df).collect():
        taken[x.source] += len(WORD.findall(x.text))
        times[x.source, x.text] += 1
    assert taken == Counter(goal)
    # One row of a source at most is cut; the others are there as often as the passes, or once more.
    for s in goal:
        counts = [times[s, t] / sum(m[1] == t for m in made) for t in {m[1] for m in made if m[3] == s}]
        assert max(counts) - min(counts) <= 1


def test_schedules():
    assert [mixing.integral(k) for k in mixing.SCHEDULES] == [1.0, 2.0, 3.0]


def test_positions_invert_demand(spark):
    shares = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    for rank, (a, b) in enumerate(mixing.SCHEDULES):
        df = spark.createDataFrame([(x,) for x in shares], "x double").select("x", mixing.position(F.col("x"), F.lit(rank)).alias("t"))
        for r in df.collect():
            assert abs(a * r.t + (b - a) * r.t**2 / 2 - r.x * (a + b) / 2) < 1e-9


def test_packing(docs, nulls, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER).collect()
    want = sorted((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows())
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        ids = tuple(np.frombuffer(r.ids, dtype="<u4").tolist())
        assert r.length == len(ids) <= 1024 and r.ids_crc32 == zlib.crc32(r.ids) and (r.piece == 0 or r.length == 1024)
        by_doc.setdefault(r.doc_id, {}).setdefault(r.start, []).append(ids)
    for key, ids in want:
        pieces = by_doc[key]
        assert tuple(x for start in sorted(pieces) for x in pieces[start][0]) == ids
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= 1024
    assert len(seqs) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(nulls, TOKENIZER).count() == 3 and packing.pack(empty, TOKENIZER).count() == 0


def test_ids_are_those_of_tokenizers_at_its_defaults(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from brindle.llm import queries

    tok = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y\n<|endoftext|", "<|endoftext|>", "no token", "", "a" + " " * 3000 + "b <|endoftext|>", "\n" * 1_000_001 + "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        head = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(head, len(ids), 1024)], range(head, len(ids) + 1, 1024), strict=True)):
            want[i, k] = zlib.crc32(ids[a:b].tobytes())
    for got in (queries.op1_packing(spark, str(tmp_path)), corpus_pipeline.sequences(spark, df, "")):
        assert {(r.doc_id, r.piece): r.ids_crc32 for r in got.collect()} == want


def test_files_that_are_no_plain_byte_level_bpe_go_through_tokenizers(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.plain_bytes(TOKENIZER)
    texts = ["Hello  World\n it's 12", " x", ""]
    for k, (part, name, value) in enumerate([("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "use_regex", False), (None, "normalizer", {"type": "Lowercase"})]):
        changed = json.loads(json.dumps(spec))
        (changed if part is None else changed[part])[name] = value
        path = str(tmp_path / f"t{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(changed, f)
        tok = Tokenizer.from_file(path)
        assert not packing.plain_bytes(path)
        assert [packing.encode(path, t, True) for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_uses_every_piece():
    r = np.random.default_rng(3)
    counts = np.zeros(65, dtype=np.int64)
    counts[1:] = r.integers(0, 50, 64)
    plan = packing.plan(counts)
    used = np.zeros(65, dtype=np.int64)
    for parts, n in plan:
        assert sum(parts) <= 64
        for v in parts:
            used[v] += n
    assert (used == counts).all()
    bins = []
    for v in range(64, 0, -1):
        for _ in range(counts[v]):
            at = next((i for i, free in enumerate(bins) if free >= v), None)
            if at is None:
                bins.append(64 - v)
            else:
                bins[at] -= v
    assert sum(n for _, n in plan) <= len(bins) * 1.01 + 1


def test_patterns_are_all_partitions():
    rows_ = packing.patterns(12, 3, np.ones(13, dtype=bool))
    assert sorted(tuple(int(v) for v in r) for r in rows_) == sorted((a, b, c) for a in range(13) for b in range(13) for c in range(13) if a + b + c == 12 and a >= b >= c)


def test_minhash(docs, nulls, empty):
    for n in (2, 5):
        sets, ids = [], []
        for r in rows():
            w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
            sets.append(set() if not w else {tuple(w)} if len(w) < n else set(zip(*(w[i:] for i in range(n)), strict=False)))
            ids.append(r[0])
        up = {i: i for i in ids}

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(ids)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                    a, b = root(ids[i]), root(ids[j])
                    up[max(a, b)] = min(a, b)
        got = minhash.near_duplicates(docs, ngram=n).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets, strict=True))
    assert sorted(r.kept for r in minhash.near_duplicates(nulls, ngram=2).collect()) == [True, True, True]
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0


def brute_components(made, n):
    """The smallest id that each id reaches over links of at least 80 %; ids are vertices."""
    sets = []
    for _, t in made:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < n else set(zip(*(w[i:] for i in range(n)), strict=False)))
    up = {i: i for i, _ in made}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(made[i][0]), root(made[j][0])
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(made, sets, strict=True))


@pytest.mark.parametrize("block", [3, 10, 2048])
def test_minhash_finds_links_in_and_between_blocks(spark, monkeypatch, block):
    """A large group of copies that drift apart, so that most links are between copies, not to the text they were made from."""
    r = random.Random(31)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    base = [r.choice(vocab) for _ in range(150)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(vocab)
        made.append((i * 7 % 150, " ".join(w)))
        if i % 10 == 0:
            base = w
    made += [(200 + i, " ".join(r.choice(vocab) for _ in range(60))) for i in range(20)]
    # One id on two texts joins their groups.
    made += [(300, made[0][1] + " x"), (300, made[160][1] + " y"), (301, made[160][1])]
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(4), ngram=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == brute_components(made, 2)


def test_common_counts_shared_fingerprints(monkeypatch):
    r = np.random.default_rng(9)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    got = minhash.common([s.tobytes() for s in sets[:10]], [s.tobytes() for s in sets[5:]])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:10]]
    assert minhash.common([b""], [b"", b""]).tolist() == [[0, 0]]


def test_estimates_are_close():
    r = np.random.default_rng(5)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    for shared in (200, 800, 1000):
        x, y = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
        same = float((minhash.registers(x) == minhash.registers(y)).mean())
        got = minhash.estimate(np.array([same]), np.array([1000]), np.array([1000]))[0]
        assert abs(got - shared / (2000 - shared)) < 0.12


def test_suffix(docs, nulls, empty):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    low = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows()]
    for i, x in data:
        for k in range(len(x) - 49):
            low[x[k : k + 50]] = min(i, low.get(x[k : k + 50], i))
    want = set()
    for i, x in data:
        gone = np.zeros(len(x), dtype=bool)
        for k in range(len(x) - 49):
            if low[x[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        want.add((i, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, dtype=np.uint8)[~gone])).hexdigest()))
    assert got == want
    assert suffix_dedup.remove_repeats(nulls).count() == 3 and suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("owner", [None, 5])
def test_suffix_tells_texts_apart_whose_short_digests_agree(spark, monkeypatch, owner):
    """Also with ranges of more than 16 bits."""
    if owner is not None:
        monkeypatch.setattr(suffix_dedup, "owner_column", lambda sha: F.lit(owner).cast("long"))
        monkeypatch.setattr(suffix_dedup, "owner_of", lambda digest: owner)
    monkeypatch.setattr(suffix_dedup, "range_bits", lambda size, per_range: 18)
    passage = "a passage of more than fifty bytes that two of the texts share"
    made = [(1, "first " + passage + " one"), (2, "second, " + passage), (3, "alone, and unlike the others in every word that it has to say"), (4, "first " + passage + " one")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (len(passage) + 1, 1), 3: (0, 0), 4: (len(made[3][1]), 1)}


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_likely_rows_hold_all_that_are_wanted(spark, monkeypatch, most):
    from brindle.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", most)
    rows_ = spark.range(40_000)
    wanted = spark.range(0, 40_000, 13).toDF("k")
    got = {r.id for r in common.likely(rows_, "id", wanted).collect()}
    assert got >= set(range(0, 40_000, 13)) and len(got) < 20_000
    assert common.likely(rows_, "id", wanted.where("k < 0")).count() == 0


def test_packed_numbers_come_back():
    from brindle.llm.common import packed, range_of, ranged, unpacked

    r = np.random.default_rng(1)
    for top in (1, 200, 1 << 17, 1 << 63):
        v = r.integers(0, top, 1000, dtype=np.uint64)
        assert (unpacked(packed(v), len(v)) == v).all()
    h = r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    for bits in (3, 15, 16, 20):
        t = ranged(h, bits)
        assert (range_of(t, bits) == h >> np.uint64(64 - bits)).all() and len(np.unique(t)) == len(np.unique(h))


def test_smallest_by_windows():
    r = random.Random(1)
    for _ in range(40):
        base = ["".join(r.choice("ab") for _ in range(150)).encode() for _ in range(2)]
        pieces = list({b[s : s + r.randint(40, 70)] for b in base for s in (r.randint(0, 80) for _ in range(8))} | {b"a" * 60, b"a" * 40})
        firsts = np.array([r.randint(0, 30) for _ in pieces])
        best = {}
        for c, f in zip(pieces, firsts, strict=True):
            for i in range(len(c) - 39):
                best[c[i : i + 40]] = min(f, best.get(c[i : i + 40], f))
        for c, low in zip(pieces, suffix_dedup.smallest(pieces, firsts, 40), strict=True):
            assert low.tolist() == [best[c[i : i + 40]] for i in range(len(c) - 39)]


def test_sharding(docs, nulls, empty):
    got = sharding.shard(docs, shards=3).collect()
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in rows()}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows())
    loads = [0] * 3
    for r in got:
        assert r.size == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # The largest text fills more than a third; the others are even.
    rest = sorted(loads)[:2]
    assert max(loads) == max(size.values()) and rest[1] - rest[0] <= max(v for v in size.values() if v < 6000)
    assert sharding.shard(nulls, shards=3).count() == 3 and sharding.shard(empty, shards=3).count() == 0
    assert sum(sharding.level([5, 1, 9], 10)) == 10 and sharding.level([5, 1, 9], 4) == [0, 4, 0]


def test_sharding_is_even_where_all_is_linked(spark):
    """Pairs, and a text that exceeds every quota: nothing single evens out what linked texts leave."""
    made = [(i, f"{i // 2:04d}" + "x" * 1988) for i in range(800)]
    got = sharding.shard(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(loads) - min(loads) <= 2000 and {r.size for r in got} == {2000}
    where = {r.doc_id: r.shard for r in got}
    # A pair is split at most where one shard's room ends and the next begins.
    assert sum(where[i] != where[i + 1] for i in range(0, 800, 2)) <= 24
    made = [(i, "y" * 992) for i in range(500)] + [(1000 + i, f"{i:03d}" * 10) for i in range(60)]
    got = sharding.shard(spark.createDataFrame(made, "doc_id long, text string").repartition(4), shards=7).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(7)]
    assert max(loads) - min(loads) <= 1000 and sorted(r.doc_id for r in got) == sorted(i for i, _ in made)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_drain_splits_few_texts(spark):
    """Against the state itself: bytes and counts of texts are kept, full shards end at the capacity."""
    r = random.Random(2)
    state = [(f"{hashlib.md5(str(k).encode()).hexdigest()}", size, r.randrange(3), r.randint(1, 9)) for k in range(120) for size in (r.randint(50, 400),)]
    df = spark.createDataFrame([(k, k, z, s, n) for k, z, s, n in state], "key string, tick string, size long, shard int, n long")
    capacity = -(-sum(z * n for _, z, _, n in state) // 5)
    got = sharding.drain(df, capacity, 5).collect()
    held = {}
    for x in got:
        held[x.key] = held.get(x.key, 0) + x.n
    assert held == {k: n for k, _, _, n in state}
    loads = [sum(x.n * x.size for x in got if x.shard == s) for s in range(5)]
    assert all(abs(x - capacity) <= 800 for x in loads)
    assert len(got) <= len(state) + 10


def test_scores(docs, nulls, empty):
    import math
    from collections import Counter

    for order in (1, 2, 3):
        texts = [(r[0], WORD.findall(r[1] or "")) for r in rows()]
        grams = lambda w, order=order: Counter(tuple(w[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(k - 1, len(w)))
        every = sum((grams(w) for _, w in texts), Counter())
        words = sum(len(w) for _, w in texts)
        want = []
        for key, w in texts:
            left = every.copy()
            left.subtract(grams(w))
            total = 0
            for i in range(len(w)):
                k, back = min(order, i + 1), 0
                while k > 1 and left[tuple(w[i - k + 1 : i + 1])] <= 0:
                    k, back = k - 1, back + round(1e6 * math.log(0.4))
                g = tuple(w[i - k + 1 : i + 1])
                total += back + round(1e6 * math.log(left[g] / left[g[:-1]] if k > 1 else max(left[g], 1) / max(words - len(w), 1)))
            want.append((key, len(w), total))
        got = lm.backoff_scores(docs, order=order).collect()
        assert sorted((r.doc_id, r.n_words, r.score_micro) for r in got) == sorted(want)
    assert lm.backoff_scores(nulls).count() == 3 and lm.backoff_scores(empty).count() == 0


def test_registered_trigram_query_uses_trigrams(spark, tmp_path):
    from brindle.llm import queries

    spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score_micro for r in queries.QUERIES["op6_lm_trigram"](spark, str(tmp_path)).collect()}
    # "a" is one of six words; "b" and "c" are certain after "a" and "a b". After "b" alone "c" has even odds.
    assert got[1] == got[2] == -1791759


def test_quality(docs, nulls, empty, spark):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for r in rows():
        w, text = WORD.findall(r[1] or ""), r[1] or ""
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        rep = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, rep)
        assert g.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and (g.kept is False if g.base_failed else True)
    assert [r.kept for r in quality.quality(nulls).collect()] == [False] * 3 and quality.quality(empty).count() == 0
    assert quality.drop_rejected(docs).columns == docs.columns and quality.drop_rejected(empty).count() == 0


def test_quality_rejects_planted_outliers(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    made = [(i, " ".join(r.choice(vocab) for _ in range(int(r.lognormvariate(5.5, 0.6)) + 60)), "en", f"s{i % 2}") for i in range(400)]
    made += [(1000 + i, " ".join(r.choice(vocab) + "$$$" for _ in range(200)), "en", "s0") for i in range(20)]
    got = quality.quality(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    assert all(not x.kept for x in got if x.doc_id >= 1000) and sum(x.kept for x in got if x.doc_id < 1000) >= 398


def test_quality_rejects_moderate_outliers(spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    made = [(i, "\n".join(" ".join(say(10)) for _ in range(r.randint(15, 40)))) for i in range(400)]
    # 11 % symbols; half of the lines (of two words) repeated, each by another one; just under half of the words in windows that occur again.
    for i in range(10):
        w = say(200)
        made.append((1000 + i, " ".join(x + "#" * (k % 5 < 3) for k, x in enumerate(w))))
        lines = [" ".join(say(2)) for _ in range(60)]
        made.append((2000 + i, "\n".join(r.sample(lines + lines, 120))))
        made.append((3000 + i, " ".join(w[:52] + w[:48] + say(100))))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in made], "doc_id long, text string, lang string, source string")
    got = quality.quality(df).collect()
    planted = [x for x in got if x.doc_id >= 1000]
    assert not any(x.base_failed for x in planted) and all(0.08 < x.n_symbols / x.word_chars < 0.15 for x in planted if x.doc_id < 2000)
    assert not any(x.kept for x in planted) and sum(x.kept for x in got if x.doc_id < 1000) >= 388


def robust_verdicts(rows_, support=0.75, cutoff=0.999, prior=50.0):
    """The method in numpy: two starts, concentration on the nearest share (whole distance bins), shrinkage, the smaller determinant."""
    floors = np.array(quality.FLOORS)

    def moments(parts):
        m, c = {g: x.mean(0) for g, x in parts.items()}, {g: np.cov(x.T, bias=True) for g, x in parts.items()}
        n = {g: len(x) for g, x in parts.items()}
        total = sum(n.values())
        pm, pc = sum(m[g] * n[g] for g in parts) / total, sum(c[g] * n[g] for g in parts) / total
        w = {g: n[g] / (n[g] + prior) for g in parts}
        return {g: (w[g] * m[g] + (1 - w[g]) * pm, w[g] * c[g] + (1 - w[g]) * pc) for g in parts}, total

    def plus(c):
        out = c.copy()
        out[np.diag_indices(len(c))] = np.maximum(np.diag(c), 0) + floors**2
        return out

    def far(x, m, c):
        e = x - m
        return np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e)

    def nearest(fits):
        out = {}
        for g, x in rows_.items():
            bins = np.floor(np.log2(far(x, *fits[g]) + 1e-12) * 32)
            out[g] = x[bins <= np.sort(bins)[int(np.ceil(len(x) * support)) - 1]]
        return out

    def inner(x):
        sd = np.sqrt(np.maximum(np.var(x, 0), 0))
        return x[(np.abs(x - x.mean(0)) <= 1.5 * sd + floors).all(1)]

    best, runs = {}, []
    for parts in (rows_, {g: inner(x) for g, x in rows_.items()}):
        fits = {g: (m, plus(c)) for g, (m, c) in moments(parts)[0].items()}
        runs.append(fits)
    # Both starts go on until neither moves in any group.
    sizes_of = lambda: np.array([[np.linalg.slogdet(f[1])[1] for f in fits.values()] for fits in runs])
    old = sizes_of()
    for _ in range(25):
        runs = [{g: (m, plus(c)) for g, (m, c) in moments(nearest(fits))[0].items()} for fits in runs]
        size = sizes_of()
        if np.abs(size - old).max() < quality.STILL:
            break
        old = size
    for fits in runs:
        for g, f in fits.items():
            if g not in best or np.linalg.slogdet(f[1])[1] < np.linalg.slogdet(best[g][1])[1] - 1e-9:
                best[g] = f
    factor = support / quality.chi2_cdf(quality.chi2_quantile(support, quality.D), quality.D + 2)
    last, total = moments(nearest(best))
    out = {}
    for g, (m, c) in last.items():
        c = c * factor * np.where(np.eye(quality.D), 1.0, min(total / (total + prior), 0.99))
        c[np.diag_indices(quality.D)] = np.maximum(np.diag(c), floors**2)
        out[g] = far(rows_[g], m, c)
    return out, quality.chi2_quantile(cutoff, quality.D)


def test_quality_verdicts_match_numpy(spark):
    r = random.Random(17)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    made = []
    for i in range(500):
        w = [r.choice(vocab) + "#" * (r.random() < r.choice((0, 0, 0, 0.1, 0.3))) for _ in range(r.randint(60, 400))]
        lines = [" ".join(w[k : k + 8]) for k in range(0, len(w), 8)]
        lines += r.choices(lines, k=r.choice((0, 0, 0, 1, 2, len(lines) // 3)))
        made.append((i, "\n".join(lines), "en" if i % 3 else "de", f"s{i % 2}"))
    docs_ = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.quality(docs_).collect()}
    by = {}
    for i, t, lang, source in made:
        x = got[i]
        if not x.base_failed:
            lines = sum(bool(WORD.search(y)) for y in t.split("\n"))
            v = [np.log1p(x.n_words), np.log(x.word_chars / x.n_words), x.n_symbols / x.word_chars, x.n_dup_lines / (lines + 10), x.n_repeat_words / (x.n_words + 50)]
            by.setdefault((lang, source), []).append((i, v))
    want, limit = robust_verdicts({g: np.array([v for _, v in x]) for g, x in by.items()})
    checked = 0
    for g, x in by.items():
        for (i, _), d in zip(x, want[g], strict=True):
            assert abs(got[i].distance - d) <= 1e-6 * max(1.0, d) and got[i].kept == (d <= limit)
            checked += 1
    assert checked > 400 and 0 < sum(not x.kept and not x.base_failed for x in got.values()) < 300


def test_determinant_estimate_matches_numpy(spark):
    """The Gauss-Jordan fold gives the inverse and log-determinant of the regularised covariance."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, quality.D)) @ r.normal(size=(quality.D, quality.D))
    df = spark.createDataFrame([("g", 0, *map(float, v)) for v in x], "g string, start int, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = quality._estimates(quality._moments(df, ["g", "start"]), ["start"], 50.0).first()
    cov = np.cov(x.T, bias=True) + np.diag([f * f for f in quality.FLOORS])
    assert np.allclose(np.array(got.p).reshape(quality.D, -1), np.linalg.inv(cov)) and abs(got.ld - np.linalg.slogdet(cov)[1]) < 1e-9
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 5) - 0.75) < 1e-12 and abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5


def test_chat_trees(spark):
    said = [(1, 1, None, "user", "hi & </s>", 1.0), (1, 2, 1, "assistant", "a [INST]", 5.0), (1, 3, 1, "assistant", "b", 1.0), (1, 4, 2, "user", "&lt;", 1.0), (1, 5, 3, "user", "last", 9.0), (1, 6, 5, "assistant", "deep", None)]
    said += [(2, 1, 9, None, None, 0.0), (None, 1, None, "assistant", "x", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(said, "c long, n long, up long, role string, text string, score double")
    got = chat.format_paths(df, "c", "n", "up", "role", "text", "score", top=2)
    out = {(r.c, r.leaf): r for r in got.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(out) == {(1, 4), (1, 6), (2, 1), (None, 1)}
    assert [tuple(t) for t in out[1, 4].turns] == [("user", "hi & </s>"), ("assistant", "a [INST]"), ("user", "&lt;")] and out[1, 4].loss == "a [INST]"
    assert out[1, 6].loss == "bdeep" and [tuple(t) for t in out[2, 1].turns] == [("", "")] and out[None, 1].loss == "x"
    best = chat.format_paths(df, "c", "n", "up", "role", "text", "score").where("c = 1").collect()
    assert [r.leaf for r in best] == [6]
    assert chat.format_paths(df.where("c = 99"), "c", "n", "up", "role", "text", "score").count() == 0
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)], df.schema)
    assert [t.text for t in chat.format_paths(deep, "c", "n", "up", "role", "text", "score").select(chat.read_back(F.col("formatted")).alias("t")).first().t] == [str(i) for i in range(37)]


def test_chat_repeated_rows_long_texts_and_other_columns(spark):
    long_ = "</s>&[INST]" * 20_000
    said = [(1, 1, None, "user", "a", 1.0, "x"), (1, 2, 1, "assistant", "a", 1.0, "x"), (1, 3, 2, "user", "a", 1.0, "x"), (1, 4, 3, "assistant", long_, 1.0, "x")]
    df = spark.createDataFrame(said + said, "c long, n long, up long, role string, text string, score double, formatted string")
    got = chat.format_paths(df, "c", "n", "up", "role", "text", "score").select("leaf", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 1 and [tuple(t) for t in got[0].t] == [("user", "a"), ("assistant", "a"), ("user", "a"), ("assistant", long_)] and got[0].loss == "a" + long_
    with pytest.raises(ValueError, match="identifier"):
        chat.format_paths(df.unionByName(df.withColumn("text", F.lit("b"))), "c", "n", "up", "role", "text", "score")


def test_warc(spark):
    big = "".join(random.Random(4).choice("abcdefghijklmnop<>\n") for _ in range(30_000))
    pages = [(1, "http://a/\r\nx", "p" * 200), (2, None, "p" * 200), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "ü", big), (8, "u", big), (None, "u", "p" * 200), (9, "u", "ü" * 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(df)
    for split in (64, 1000, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(spark, manifest, split_bytes=split).collect()}
        assert len(got) == len(pages)
        for key, _, html in pages:
            data = (html or "").encode()
            first = min(k for k, _, h in pages if k is not None and (h or "") == (html or ""))
            again = len(data) >= 100 and key != first
            r = got[key]
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
            assert r.payload is None if again else bytes(r.payload) == data
    assert warc.write_archives(df.where("page_id > 99")).count() == 0 and warc.read_archives(spark, warc.write_archives(df.where("page_id > 99"))).count() == 0


def test_warc_keeps_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "p" * 200, "a", 1), (1, "u", "p" * 200, "b", 2), (2, "u", "p" * 200, "c", 3)], "page_id long, url string, html string, payload string, salt int")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(df)).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


@pytest.mark.parametrize("where", ["head", "body", "cut", "gone"])
def test_damaged_archives_fail_by_name(spark, tmp_path, where):
    made = [warc.member(warc.record(str(i), "u", (f"page {i} " * 300).encode(), "0", 2400, None)) for i in range(3)]
    if where == "head":
        made[1] = b"x" + made[1][1:]
    elif where == "body":
        made[1] = made[1][:-20] + bytes([made[1][-20] ^ 1]) + made[1][-19:]
    elif where == "cut":
        made[2] = made[2][:-30]
    else:
        made.pop()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(made))
    for split in (50, 1 << 20):
        manifest = spark.createDataFrame([(path.as_uri(), path.stat().st_size, 3)], "path string, n_bytes long, n_records long")
        with pytest.raises(Exception, match="a.warc.gz"):
            warc.read_archives(spark, manifest, split_bytes=split)


def test_members_skips_what_only_looks_like_one():
    a, b = warc.member(b"WARC/1.1\r\nA: 1\r\n\r\nx"), warc.member(b"other")
    data = b"junk" + warc.MAGIC + b"zz" + a + b + a
    found = list(warc.members(lambda at, n: data[at : at + n], 1, len(data), len(data), strict=False))
    assert len(found) == 2 and all(x.startswith(b"WARC/") for x in found)


def test_suffix_order(monkeypatch):
    """Any suffixes that agree on the first symbols may swap; the ranks come by two sorts of the text, not four."""
    r = np.random.default_rng(5)
    text = np.append(r.integers(1, 4, 3000, dtype=np.uint8), np.zeros(1, dtype=np.uint8))
    calls, real = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or real(*a, **k))
    order = suffix_dedup.suffix_order(text, 51)
    shown = [bytes(text[i : i + 51]) for i in order]
    assert shown == sorted(shown) and sorted(order.tolist()) == list(range(len(text)))
    assert len(calls) == 2
