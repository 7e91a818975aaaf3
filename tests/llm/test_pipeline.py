"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import zlib

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, TOKENIZER, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), SCHEMA).select(*COLUMNS).repartition(3).write.parquet(str(top / "documents.parquet"))
    docs, out = spark.read.parquet(str(top / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(top)).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out[name] = docs
    out["sf"] = str(top)
    return out


def kept(df):
    return Counter(r.doc_id for r in df.collect())


def sets(text, n=5):
    w = [x.lower() for x in WORD.findall(text or "")]
    return set() if not w else {tuple(w)} if len(w) < n else set(zip(*(w[i:] for i in range(n)), strict=False))


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(stages[n].columns == COLUMNS for n in ("quality_rules", "exact_dedup", "near_dedup", "mixing"))
    assert corpus_pipeline.ORACLE_SQL is None


def test_filters(stages):
    text = {r[0]: r[1] for r in rows()}
    good = kept(stages["quality_rules"])
    for r in rows():
        w = WORD.findall(r[1] or "")
        at = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = len({i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if at[g] > 1 for k in range(3)})
        if len(w) < 50 or 100 * rep > 50 * len(w):
            assert r[0] not in good
    first = {}
    for i in sorted(good):
        first.setdefault(" ".join(WORD.findall(text[i])), i)
    exact = kept(stages["exact_dedup"])
    # Leading and trailing white space tells texts apart; here none has any.
    assert exact == Counter(first.values())
    up = {i: i for i in exact}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in exact:
        for j in exact:
            a, b = sets(text[i]), sets(text[j])
            if j < i and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert kept(stages["near_dedup"]) == Counter({root(i) for i in exact})


def test_mix_and_packing(stages):
    before = {r.doc_id: r for r in stages["near_dedup"].collect()}
    mixed = stages["mixing"].collect()
    words = {s: sum(len(WORD.findall(r.text)) for r in before.values() if r.source == s) for s in {r.source for r in before.values()}}
    taken = Counter()
    for r in mixed:
        assert before[r.doc_id].text.strip().startswith(r.text.strip()) and r.n_chars == len(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    assert abs(sum(taken.values()) - sum(words.values())) <= len(words) and all(taken[s] <= 3 * words[s] for s in words)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in mixed:
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], dtype="<u4")
        head = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(head, len(ids), 1024)], range(head, len(ids) + 1, 1024), strict=True)):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = stages["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    place = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for a, b in zip(place, place[1:], strict=False):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 1024


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, stages["sf"]).count() == stages["packing"].count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
