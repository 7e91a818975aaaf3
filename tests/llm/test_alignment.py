"""Alignment of two tokenizers, against loops over tokens."""

import hashlib
import random
import weakref
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from brindle.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, a int, links string, row long"


def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 9))) for _ in range(200)]
    odd = ["é", "ü€", "😀😀", "你好", "\n", "\t", "\r\n", "<|endoftext|>", "<s>", "<0x0A>", "▁", "it's", " ", "12,345", "\x00", "ﬁ"]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(40)]
    out += ["".join(r.choice([*vocab[:20], *odd, " ", " ", "  ", "   "]) for _ in range(r.randint(1, 40))) for _ in range(160)]
    out += [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "a \n", "a\n ", "a\n b", "\n \n b", "a\n \nb", "x" * 3000, " " * 1500, "▁a", "a b c " * 4000]
    return out + out[:5] + [out[3]] * 7


def ends(entries):
    at, out = 0, []
    for e in entries:
        at += len(e)
        out.append(at)
    return out


def expected(rows):
    tok, model = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    tok.encode_special_tokens = True
    docs, held = [], Counter()
    for text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        x, y = [alignment.byte_entries(FIRST)[i] for i in a], [alignment.piece_entries(SECOND)[i] for i in b]
        if not text or not b"".join(x) == b"".join(y) == f" {text}".encode():
            docs.append(([], [], [], Counter()))
            continue
        cuts = sorted(set(ends(x)) & set(ends(y)))
        group = {c: ([], []) for c in cuts}
        for side, (ids, at) in enumerate(((a, ends(x)), (b, ends(y)))):
            for i, e in zip(ids, at, strict=True):
                group[next(c for c in cuts if c >= e)][side].append(i)
        groups = [group[c] for c in cuts]
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        held.update(links.keys())
        docs.append((a, b, groups, links))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()), sha))
    return out


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 10])
def test_counts(spark, pairs):
    rows = [t for t in texts() if t is None or len(t) < 5000]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_counts(docs, FIRST, SECOND, pairs=pairs).collect()}
    want = expected(rows)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i] == w, (i, rows[i])
    assert sum(w[0] > 0 for w in want) > 100
    assert sum(w[0] == 0 and bool(t) for w, t in zip(want, rows, strict=True)) > 3


def test_whole_tokens(spark):
    """Tokens by units are the tokenizers' own on whole texts; the ends are those of their bytes."""
    rows = texts()
    tok, model = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    tok.encode_special_tokens = True
    got = alignment.align(spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(rows)], SCHEMA), FIRST, SECOND).collect()
    for r in got:
        t = rows[r.doc_id]
        if r.a:
            assert r.a == tok.encode(f" {t}", add_special_tokens=False).ids
            assert r.b == model.encode(t)
            assert r.a_ends == ends(alignment.byte_entries(FIRST)[i] for i in r.a)
            assert r.a_ends[-1] == r.b_ends[-1] == len(f" {t}".encode())
            assert [i for g in r.groups for i in g.x] == r.a and [i for g in r.groups for i in g.y] == r.b
    assert sum(len(r.a) > 10_000 for r in got) == 1


def test_nulls_and_repeats(spark):
    rows = [(None, "one two", None, None, None, None), (None, None, None, None, None, None), (4, "one two", None, None, None, None), (4, "three", None, None, None, None)]
    got = alignment.link_counts(spark.createDataFrame(rows, SCHEMA), FIRST, SECOND).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, 1), (False, 2), (True, 0), (True, 2)]
    assert {r.count_sum for r in got if r.n_a == 2} == {4}
    assert alignment.link_counts(spark.createDataFrame([], SCHEMA), FIRST, SECOND).collect() == []


def test_slices(monkeypatch):
    """Units of many small slices, put together, are the tokens of the texts; numbers of tokens and ends agree."""
    rows = [t or "" for t in texts() if t is None or len(t) < 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["id", "text"])
    monkeypatch.setattr(alignment, "SLICE", 300)
    whole = {r["id"]: r for b in alignment._tokens([batch], FIRST, SECOND) for r in b.to_pylist()}
    slices = [r for b in alignment._slices([batch], FIRST, SECOND) for r in b.to_pylist()]
    assert len(slices) > 10
    seen = 0
    for s in slices:
        for side in ("a", "b"):
            at = [0, *(s[f"{side}_ends"].index(e) + 1 for e in s["unit_ends"])]
            unit = [s[side][i:j] for i, j in zip(at, at[1:], strict=False)]
            for d in s["docs"]:
                want = whole[d["id"]][side]
                assert [i for u in d["units"] for i in unit[u]] == want and d[f"n_{side}"] == len(want)
                seen += side == "a"
    assert seen == len(rows)


@pytest.mark.parametrize("frequent", [0, 3, alignment.FREQUENT])
def test_frequent_units(spark, frequent, monkeypatch):
    """Units aligned once for all slices change nothing, however many they are."""
    monkeypatch.setattr(alignment, "SLICE", 300)
    rows = [t for t in texts() if t is None or len(t) < 5000]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(rows)], SCHEMA).repartition(2)
    assert len(alignment.frequent_units(docs.na.fill("").select("text"), frequent)) == min(frequent, 3) or frequent > 3
    got = {r.id: (r.n_a, r.n_b, r.n_groups, len(r.links), r.groups_sha256) for r in alignment.by_document(docs, FIRST, SECOND, "doc_id", "text", frequent).collect()}
    assert [got[i] for i in range(len(rows))] == [(*w[:4], w[6]) for w in expected(rows)]


def test_slices_leave_frequent_units_out():
    """A slice's row has only the units that are not frequent; a unit whose tokens do not join to it is never frequent."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two one", "two three"])], ["id", "text"])
    (row,) = [r for b in alignment._slices([batch], FIRST, SECOND, ["two", "▁", "one"]) for r in b.to_pylist()]
    assert [d["units"] for d in row["docs"]] == [[1, 0, 1], [0, 2]] and len(row["unit_ends"]) == 1
    assert row["unit_ends"] == [len(" three")]


@pytest.mark.parametrize("keep", [alignment.KEEP, 0])
def test_workers_keep_frequent_units(keep, monkeypatch):
    """A worker's next task tokenises no frequent unit again, nor does a worker that forgets its other units; the rows stay the same."""
    frequent, said, encode = ["two", "one", "▁", f"kept{keep}"], [], alignment.first_ids
    monkeypatch.setattr(alignment, "KEEP", keep)
    monkeypatch.setattr(alignment, "SLICE", 1)
    monkeypatch.setattr(alignment, "first_ids", lambda path, units: [said.extend(units), encode(path, units)][1])
    texts = ["one two one", "two three", "four four two", "three four"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["id", "text"])
    tasks = [[r for b in alignment._slices([batch], FIRST, SECOND, frequent) for r in b.to_pylist()] for _ in range(3)]
    assert said[:4] == frequent and not set(frequent) & set(said[4:])
    assert sorted(said[4:]) == (["four"] * 6 + ["three"] * 6 if keep == 0 else ["four", "three"])
    for rows in tasks:
        for i, r in enumerate(rows):
            ids = encode(FIRST, [u for u in frequent if u != "▁"])
            at = [0, *(r["a_ends"].index(e) + 1 for e in r["unit_ends"])]
            ids += [r["a"][x:y] for x, y in zip(at, at[1:], strict=False)]
            assert [j for u in r["docs"][0]["units"] for j in ids[u]] == encode(FIRST, [texts[i]])[0]


def test_units_of_one_table_at_a_time(monkeypatch):
    """A worker that meets another table's frequent units has let go of those before when it makes them."""
    kept = weakref.WeakSet()

    class Made(alignment.Units):
        def __init__(self, *sides, first=()):
            assert not kept
            super().__init__(*sides, first=first)
            kept.add(self)

    monkeypatch.setattr(alignment, "Units", Made)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"])], ["doc_id", "text"])
    for frequent in (["one table"], ["one table"], ["another"]):
        assert len(list(alignment._slices([batch], FIRST, SECOND, frequent))) == 1
    assert [k.first for k in kept] == [("another",)]


def test_units_of_a_slice():
    """A unit's ends count from its start, and each of its bytes has the place of its token; a slice without other units has none."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["thüaeinö chökeitte 你好", "it's", ""])], ["id", "text"])
    (row,) = [r for b in alignment._nested(alignment._slices([batch], FIRST, SECOND, ["slice"])) for r in b.to_pylist()]
    assert list(row) == ["docs", "units"] and len(row["units"]) == 4
    for u, text in zip(row["units"], ["thüaeinö", "chökeitte", "你好", "it's"], strict=True):
        for c, entries in (("a", alignment.byte_entries(FIRST)), ("b", alignment.piece_entries(SECOND))):
            assert b"".join(entries[i] for i in u[c]) == f" {text}".encode()
            assert u[f"{c}_ends"] == ends(entries[i] for i in u[c])
            assert u[f"{c}_of"] == [k for k, i in enumerate(u[c]) for _ in entries[i]]
    (none,) = [r for b in alignment._nested(alignment._slices([batch.slice(1, 1)], FIRST, SECOND, ["it's"])) for r in b.to_pylist()]
    assert none["units"] == [] and none["docs"][0]["units"] == [0]


def test_groups_of_units(spark):
    """Groups and links by cuts and by tokens, of units whose tokens end at the same places and of others, in the order of the units."""
    rows = [
        ([1, 2], [2, 5], [0, 0, 1, 1, 1], [7, 8], [2, 5], [0, 0, 1, 1, 1]),
        ([1, 2, 3], [2, 3, 6], [0, 0, 1, 2, 2, 2], [7, 8, 9], [1, 3, 6], [0, 1, 1, 2, 2, 2]),
        ([4], [3], [0, 0, 0], [5, 6], [1, 3], [0, 1, 1]),
    ]
    units = spark.createDataFrame([(rows,), ([],)], alignment.T.StructType([alignment.T.StructField("units", alignment.T.ArrayType(alignment.T.StructType(alignment.UNIT), False))]))
    got = units.select(alignment._by_unit("units").alias("made")).collect()
    pairs = lambda *p: [a * alignment.WIDE + b for a, b in p]
    assert [(u.links, u.said) for u in got[0].made] == [
        (pairs((1, 7), (2, 8)), "1|7;2|8"),
        (pairs((1, 7), (1, 8), (2, 7), (2, 8), (3, 9)), "1,2|7,8;3|9"),
        (pairs((4, 5), (4, 6)), "4|5,6"),
    ]
    assert got[1].made == []
