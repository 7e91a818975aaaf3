"""Links between the tokens of two tokenizers over the same text.

Python only tokenises. It returns ids and the byte offsets at which tokens end,
for each text, or for the distinct units of a slice of texts with each text's
units by number, and for each byte of a unit the place of its token. All else
is arrays inside the JVM: ``array_intersect`` of the two arrays of ends gives
the offsets where tokens of both end, which cut the text into groups; the
tokens of the bytes behind one cut and before the next are a group's first and
last, a ``sequence`` of places takes those between them and nested
``transform`` its links. Where all tokens of a unit end at the same places,
``zip_with`` does. Each step is linear in the text, or a sort of two runs that
ascend: no array grows element by element.

No group crosses the end of a unit, where both tokenizers end a token. So
:func:`link_counts` aligns each distinct unit of a slice once, and a document's
groups and links are those of its units, one after the other. The ``FREQUENT``
units that a sample of texts holds most often are aligned once for all slices,
as one row that is broadcast; which they are decides nothing but the time.

Corpus-wide counts are a partial aggregate of each document's distinct pairs. A
pair's count meets the documents again by a broadcast of the counts where they
are at most ``PAIRS`` rows, and else by a shuffle of each document's pairs.

Tokenising goes by units, a space and what follows up to the next one, which
neither tokenizer's tokens cross in plain text: a worker keeps the tokens of
units it has seen, from task to task. Texts in which white space runs together
around a space go through the tokenizers whole, and so does any whose units do
not give its bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import batched, chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import free_shuffles, release, table
from brindle.llm.packing import encoder, plain_bytes, whole

#: Characters of text that are tokenised, and whose units are aligned, at a time, and characters of units that a worker keeps besides the frequent ones.
SLICE, KEEP = 1 << 19, 1 << 20
#: Pairs whose counts are broadcast, at most: some 100 MB.
PAIRS = 1 << 21
#: A space between white space, or before the end behind white space: a run of which a tokenizer may make one token.
RUN = re.compile(r"\s (?!\S)|  ")
#: Units longer than this are not kept.
LONG = 64
#: Units that are aligned once for all slices, at most, and texts that they are taken from, about.
FREQUENT, SAMPLE = 1 << 18, 1 << 14


@lru_cache(maxsize=2)
def byte_entries(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if i in added else bytes(byte[c] for c in token)
    for i, token in added.items():
        out[i] = token.encode()
    return out


@lru_cache(maxsize=2)
def pieces(path: str):
    """A sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_entries(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    model = pieces(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]


def by_units(path: str) -> bool:
    """Whether no piece of a sentencepiece model has a space behind another character: then none crosses the start of a unit."""
    return not any(b" " in p.lstrip(b" ") for p in piece_entries(path))


def first_ids(path: str, texts: list[str]) -> list[list[int]]:
    """The ids of a space and each text, by a ``tokenizers`` file; strings of special tokens are plain text."""
    tok = whole(path, False)
    if not plain_bytes(path):
        return [e.ids for e in tok.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    enc = encoder(path)
    return [enc.encode_ordinary(f" {t}") if len(t) <= LONG else tok.encode(f" {t}", add_special_tokens=False).ids for t in texts]


def second_ids(path: str, texts: list[str]) -> list[list[int]]:
    """The ids of each text by a sentencepiece model, which puts a space before it."""
    return pieces(path).encode(texts, num_threads=1)


class Side:
    """One tokenizer's tokens of all units, in flat arrays, and whether a unit's tokens join to its bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode, self.entries = encode, entries
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.ids, self.start, self.ok = array("i"), array("q", [0]), bytearray()

    def forget(self, but: int) -> None:
        """Forgets all units but the first."""
        del self.ids[self.start[but] :], self.start[but + 1 :], self.ok[but:]

    def learn(self, units: list[str]) -> None:
        each = self.encode(units)
        flat = list(chain.from_iterable(each))
        self.start.extend((self.start[-1] + np.cumsum(list(map(len, each)))).tolist())
        self.ids.extend(flat)
        if b"".join(map(self.entries.__getitem__, flat)) == " ".join(["", *units]).encode():
            self.ok.extend(b"\1" * len(units))
        else:
            self.ok.extend(b"".join([self.entries[i] for i in ids]) == f" {u}".encode() for u, ids in zip(units, each, strict=True))

    def tokens(self, place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts of ``counts`` units each: ids and ends of all tokens, and each text's number of tokens."""
        start, ids = np.frombuffer(self.start, dtype=np.int64), np.frombuffer(self.ids, dtype=np.int32)
        first = start[place]
        n = start[place + 1] - first
        flat = ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        offsets = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
        ends = np.append(0, np.cumsum(self.size[flat]))
        ends = ends[1:] - np.repeat(ends[offsets[:-1]], np.diff(offsets))
        return flat, ends.astype(np.int32), np.diff(offsets)

    def sizes(self, place: np.ndarray) -> np.ndarray:
        """The number of tokens of each unit."""
        return np.diff(np.frombuffer(self.start, dtype=np.int64))[place]


class Units:
    """Numbers the units as they come, those of ``first`` first, and has their tokens by both tokenizers."""

    def __init__(self, *sides: Side, first: tuple[str, ...] = ()):
        self.sides, self.first = sides, first
        self.at: dict[str, int] = defaultdict(count().__next__)
        self.kept = 0
        for some in batched(first, 1 << 14):
            self.places(some)
        self.kept = 0

    def forget(self) -> None:
        """Forgets all units but the first."""
        n = len(self.first)
        self.at = defaultdict(count(n).__next__, zip(self.first, range(n), strict=True))
        self.kept = 0
        for side in self.sides:
            side.forget(n)

    def places(self, units: Sequence[str]) -> np.ndarray:
        known = len(self.at)
        place = np.array(list(map(self.at.__getitem__, units)), dtype=np.int64)
        new = list(islice(reversed(self.at), len(self.at) - known))[::-1]
        if new:
            self.kept += sum(map(len, new))
            for side in self.sides:
                side.learn(new)
        return place

    def right(self, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For texts of ``counts`` units each, whether both sides' tokens join to every unit."""
        edge = np.append(0, np.cumsum(counts))
        wrong = ~np.logical_and(*(np.frombuffer(side.ok, dtype=bool)[place] for side in self.sides))
        return np.diff(np.append(0, np.cumsum(wrong))[edge]) == 0


def _sliced(lengths: list[int]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, n in enumerate(lengths):
        if i > a and size + n > SLICE:
            yield a, i
            a, size = i, 0
        size += n
    if lengths:
        yield a, len(lengths)


#: A worker's one :class:`Units`, by what it was made of.
KNOWN: dict[tuple[str, str, tuple[str, ...]], Units] = {}


def _units(first: str, second: str, frequent: tuple[str, ...]) -> Units:
    """A worker's units, with which its next task goes on. Those of another table are let go before any are made: two would not fit."""
    key = (first, second, frequent)
    if key not in KNOWN:
        KNOWN.clear()
        KNOWN[key] = Units(Side(lambda t: first_ids(first, t), byte_entries(first)), Side(lambda t: second_ids(second, t), piece_entries(second)), first=frequent)
    return KNOWN[key]


def _read(batches: Iterator[pa.RecordBatch], first: str, second: str, frequent: Sequence[str]) -> Iterator[tuple[pa.Array, Units, np.ndarray, np.ndarray]]:
    """By slices: the texts' ids, all units known so far, the numbers of the texts' units in a row, and how many each text has.

    Empty texts and those whose tokens do not join to a space and the text have none.
    """
    known = _units(first, second, tuple(frequent))
    apart = plain_bytes(first) and by_units(second)
    for batch in batches:
        for lo, hi in _sliced(pc.utf8_length(batch.column(1)).to_pylist()):
            texts = batch.column(1).slice(lo, hi - lo).to_pylist()
            split = [t.split(" ") if apart and not RUN.search(f" {t}") else [t] for t in texts]
            for again in range(2):
                counts = np.array([len(s) for s in split])
                place = known.places([u for s in split for u in s])
                good = known.right(place, counts)
                if again or all(g or len(s) == 1 for g, s in zip(good, split, strict=True)):
                    break
                split = [s if g else [t] for t, s, g in zip(texts, split, good, strict=True)]
            good &= np.array([t != "" for t in texts])
            yield batch.column(0).slice(lo, hi - lo), known, place[np.repeat(good, counts)], counts * good
            if known.kept > KEEP:
                known.forget()


def _lists(n: np.ndarray, items: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(items.astype(np.int32)))


def _tokens(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    """(id, a, a_ends, b, b_ends) of each text."""
    for ids, known, place, counts in _read(batches, first, second, []):
        columns = [ids]
        for side in known.sides:
            flat, ends, n = side.tokens(place, counts)
            columns += [_lists(n, flat), _lists(n, ends)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "a", "a_ends", "b", "b_ends"])


def _right(known: Units) -> np.ndarray:
    """The places of the frequent units whose tokens join to them."""
    n = len(known.first)
    return np.flatnonzero(known.right(np.arange(n), np.ones(n, dtype=np.int64))) if n else np.arange(0)


def _aligned(known: Units, distinct: np.ndarray) -> list[pa.Array]:
    """(unit_ends, a, a_ends, b, b_ends) of the units at the places ``distinct``, one behind the other."""
    columns, one = [], np.array([len(distinct)])
    for side in known.sides:
        flat, ends, n = side.tokens(distinct, one)
        if not columns:
            columns.append(_lists(one, ends[np.cumsum(side.sizes(distinct)) - 1]))
        columns += [_lists(n, flat), _lists(n, ends)]
    return columns


ALIGNED = ["unit_ends", "a", "a_ends", "b", "b_ends"]


def _frequent(batches: Iterator[pa.RecordBatch], first: str, second: str, frequent: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The frequent units, for each row read."""
    for batch in batches:
        known = _units(first, second, tuple(frequent))
        for _ in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays(_aligned(known, _right(known)), ALIGNED)


def _slices(batches: Iterator[pa.RecordBatch], first: str, second: str, frequent: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """(docs, unit_ends, a, a_ends, b, b_ends), a row a slice: each text's id, numbers of tokens, and units, and the slice's distinct units that are not frequent.

    Units are numbers: the frequent ones come first, then the slice's.
    """
    number = None
    for ids, known, place, counts in _read(batches, first, second, frequent):
        if number is None:
            right = _right(known)
            number = np.full(len(frequent), -1)
            number[right] = np.arange(len(right))
        edge = np.append(0, np.cumsum(counts))
        sizes = [pa.array(np.diff(np.append(0, np.cumsum(side.sizes(place)))[edge])) for side in known.sides]
        own = place >= len(frequent)
        units = np.empty(len(place), dtype=np.int64)
        units[~own] = number[place[~own]]
        distinct, back = np.unique(place[own], return_inverse=True)
        units[own] = len(right) + back
        docs = pa.StructArray.from_arrays([ids, *sizes, _lists(counts, units)], ["id", "n_a", "n_b", "units"])
        columns = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), *_aligned(known, distinct)]
        yield pa.RecordBatch.from_arrays(columns, ["docs", *ALIGNED])


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, one a batch, with an array of structs ``units`` for :data:`ALIGNED`.

    A unit has its tokens' ids a and b, their ends from the unit's start, and for each byte the place of its token (a_of, b_of).
    """
    for batch in batches:
        last = batch.column("unit_ends").flatten().to_numpy()
        size = np.diff(np.append(0, last))
        columns = []
        for side in ("a", "b"):
            ends = batch.column(f"{side}_ends").flatten().to_numpy()
            stop = np.searchsorted(ends, last, side="right")
            n = np.diff(np.append(0, stop))
            of = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends))) - np.repeat(stop - n, size)
            columns += [_lists(n, batch.column(side).flatten().to_numpy()), _lists(n, ends - np.repeat(last - size, n)), _lists(size, of)]
        units = pa.StructArray.from_arrays(columns, [f.name for f in UNIT])
        others = [c for c in batch.schema.names if c not in ALIGNED]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units)], [*others, "units"])


def _among(cuts: Column, ends: Column) -> Column:
    """A tokenizer's ends in order, those that are cuts twice."""
    return F.sort_array(F.concat(cuts, ends))


def _at(cuts: Column, both: Column) -> Column:
    """The places of a tokenizer's tokens that end at ``cuts``, given :func:`_among`, behind a first place of -1."""
    places = F.filter(F.sequence(F.lit(0), F.size(both) - 2), lambda i: both[i] == both[i + 1])
    # Each cut before is there twice.
    places = F.when(F.size(cuts) > 0, F.transform(places, lambda i, g: i - g)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(-1)), places)


def _items(ids: Column, first: Column, last: Column) -> Column:
    """The ids at the places ``first`` to ``last``. Not by slice, which inside a lambda looks at its whole array each time."""
    return F.transform(F.sequence(first, last), lambda i: ids[i])


#: A pair of ids as one number: the first's times this, plus the second's.
WIDE = 1 << 20


def _pair(a: Column, b: Column) -> Column:
    return a.cast("long") * WIDE + b


def _both(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit("|"), b.cast("string"))


def _by_token(u: Column) -> Column:
    """links and said of a unit in which both tokenizers' tokens end at the same places: each group is one token of each."""
    return F.struct(F.zip_with(u["a"], u["b"], _pair).alias("links"), F.array_join(F.zip_with(u["a"], u["b"], _both), ";").alias("said"))


def _by_cuts(u: Column) -> Column:
    """links and said of a unit by its cuts, the places where tokens of both end."""

    def groups(cuts: Column, single: Callable[[Column, Column], Column], several: Callable[[Column, Column], Column]) -> Column:
        def group(cut: Column, g: Column) -> Column:
            start, end = F.when(g == 0, F.lit(0)).otherwise(cuts[g - 1]), cut - 1
            first, last = [u[of][start] for of in ("a_of", "b_of")], [u[of][end] for of in ("a_of", "b_of")]
            one = (first[0] == last[0]) & (first[1] == last[1])
            return F.when(one, single(u["a"][last[0]], u["b"][last[1]])).otherwise(several(*(_items(u[c], i, j) for c, i, j in zip("ab", first, last, strict=True))))

        return F.transform(cuts, group)

    cross = lambda x, y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: _pair(a, b))))
    said = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    links = lambda cuts: F.flatten(groups(cuts, lambda a, b: F.array(_pair(a, b)), cross))
    text = lambda cuts: F.array_join(groups(cuts, _both, lambda x, y: F.concat(said(x), F.lit("|"), said(y))), ";")
    # An expression inside a lambda is computed wherever it stands: the cuts are an array's one item, to be computed once.
    return F.transform(F.array(F.array_intersect(u["a_ends"], u["b_ends"])), lambda cuts: F.struct(links(cuts).alias("links"), text(cuts).alias("said")))[0]


def _by_unit(units: str) -> Column:
    """links and said, the links and the groups as text, of each unit."""
    return F.transform(units, lambda u: F.when(u["a_ends"] == u["b_ends"], _by_token(u)).otherwise(_by_cuts(u)))


#: Arrays of numbers without nulls, which functions sort and hash unboxed.
NUMBERS = T.ArrayType(T.IntegerType(), False)
TOKENS = [T.StructField(c, NUMBERS) for c in ("a", "a_ends", "b", "b_ends")]
UNIT = [T.StructField(c, NUMBERS) for c in ("a", "a_ends", "a_of", "b", "b_ends", "b_of")]


def _cut(tokens: DataFrame) -> DataFrame:
    """Adds cuts, at, bt: the offsets where both tokenizers end, and the places of the tokens that end there.

    ``cuts``, ``at`` and ``bt`` are read more than once by what follows, so that they stay projections of their own.
    """
    cut = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    cuts = F.col("cuts")
    both = cut.withColumns({"a_both": _among(cuts, F.col("a_ends")), "b_both": _among(cuts, F.col("b_ends"))})
    return both.withColumns({"at": _at(cuts, F.col("a_both")), "bt": _at(cuts, F.col("b_both"))}).drop("a_both", "b_both")


def placed(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """(id, a, a_ends, b, b_ends, cuts, at, bt): tokens, and :func:`_cut`."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = T.StructField("id", docs.schema[id_col].dataType)
    return _cut(source.mapInArrow(lambda it: _tokens(it, first, second), T.StructType([name, *TOKENS])))


def frequent_units(texts: DataFrame, most: int) -> list[str]:
    """The units, ``most`` at most, that a sample of about ``SAMPLE`` texts' beginnings holds most often, twice at least."""
    some = texts.sample(fraction=min(1.0, SAMPLE / max(1, texts.count())), seed=1)
    units = some.select(F.explode(F.split(F.substring("text", 1, SLICE), " ")).alias("unit")).where(F.length("unit").between(1, LONG))
    units = units.groupBy("unit").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return [r.unit for r in units.orderBy(F.desc("times"), "unit").limit(most).collect()]


def by_document(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, links, groups_sha256): the ``frequent`` units aligned once, each other unit of a slice once, and put together for each document."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    often = frequent_units(source.select("text"), frequent)
    units = T.StructField("units", T.ArrayType(T.StructType(UNIT), False))
    doc = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("units", NUMBERS)])
    sent = docs.sparkSession.sparkContext.broadcast(tuple(often))
    slices = source.mapInArrow(lambda it: _nested(_slices(it, first, second, sent.value)), T.StructType([T.StructField("docs", T.ArrayType(doc, False)), units]))
    once = docs.sparkSession.range(0, 1, 1, 1).mapInArrow(lambda it: _nested(_frequent(it, first, second, sent.value)), T.StructType([units]))
    once = once.select(_by_unit("units").alias("own")).select(F.col("own.links").alias("links_0"), F.col("own.said").alias("said_0"), F.size("own").alias("often"))
    rows = slices.select("docs", _by_unit("units").alias("own")).select("docs", "own.links", "own.said").crossJoin(F.broadcast(once))
    of = lambda c: lambda u: F.when(u < F.col("often"), F.col(f"{c}_0")[u]).otherwise(F.col(c)[u - F.col("often")])

    def document(d: Column) -> Column:
        each = lambda c: F.transform(d["units"], of(c))
        said = F.when(F.size(d["units"]) > 0, F.array_join(each("said"), ";"))
        return F.struct(d["id"].alias("id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), F.flatten(each("links")).alias("links"), said.alias("said"))

    made = rows.select(F.inline(F.transform("docs", document)))
    # Groups are counted by their bars.
    n_groups = F.octet_length("said") - F.octet_length(F.replace("said", F.lit("|"), F.lit("")))
    return made.select("id", "n_a", "n_b", F.coalesce(n_groups, F.lit(0)).cast("long").alias("n_groups"), "links", F.coalesce(F.sha2("said", 256), F.lit("")).alias("groups_sha256"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, a, a_ends, b, b_ends (ids and byte offsets of the tokens of the
    ``tokenizers`` file ``first`` and the sentencepiece model ``second``, over a space and the text), and
    groups, an array of structs of the ids x and y of a group.

    Null and empty texts, and texts that the tokens of either do not give back
    byte by byte, have no tokens. Null and repeated ids stay as they are. A very
    long text is one row of arrays, in time that grows as its length (times the
    logarithm, for the sort). An empty table gives an empty result. Other columns are not read.
    """
    items = lambda ids, at, g: _items(F.col(ids), F.col(at)[g] + 1, F.col(at)[g + 1])
    groups = F.transform("cuts", lambda c, g: F.struct(items("a", "at", g).alias("x"), items("b", "bt", g).alias("y")))
    rows = placed(docs, first, second, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "a", "a_ends", "b", "b_ends", groups.alias("groups"))


def link_counts(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links (pairs of occurrences in one group), n_best
    (links whose pair is in as many documents as any of its first id), count_sum (documents with the pair, over
    links), groups_sha256 (of ``a1,a2|b1;a3|b2``; '' without tokens).

    Rows that repeat an id are documents of their own; for other cases see
    :func:`align`. Counts of more than ``pairs`` different pairs meet the
    documents by a shuffle.
    """
    spark = docs.sparkSession
    rows = by_document(docs, first, second, id_col, text_col)
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "aligned", codec="zstd")

    # In how many documents each pair is, and whether no pair of its first id is in more.
    counts = rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = table(counts.withColumn("first", F.floor(F.col("pair") / WIDE)), "pairs")
    top = counts.groupBy("first").agg(F.max("documents").alias("top"))
    known = counts.join(top, "first").select("pair", "documents", (F.col("documents") == F.col("top")).cast("long").alias("best"))
    each = rows.select("row", F.explode("links").alias("pair"))
    if counts.count() <= pairs:
        met = each.join(F.broadcast(known), "pair").select("row", "documents", "best")
    else:
        met = each.groupBy("row", "pair").agg(F.count(F.lit(1)).alias("n")).join(known.hint("shuffle_merge"), "pair")
        met = met.select("row", (F.col("documents") * F.col("n")).alias("documents"), (F.col("best") * F.col("n")).alias("best"))
    sums = table(met.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("documents").alias("count_sum")), "sums")
    free_shuffles(spark)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.select("row", "id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256").join(sums, "row", "left")
    out = table(out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "counts")
    release(rows, counts, sums)
    return out
