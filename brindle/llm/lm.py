"""Language-model scoring by stupid backoff, computed relationally.

Documents are gathered into blocks. A block explodes its n-grams of every order,
reduces them to distinct ones with counts, and sends them as packed arrays to
count tables partitioned by hash; a range of a table adds up its counts and
returns the totals to the blocks that asked, in the order of their keys. Joined
with its totals, a block sums scores per document.

A block asks for an n-gram once, however many of its documents hold it, so a
very common n-gram is no hot key, and what is shuffled follows the number of
distinct n-grams by block. Ranges are a power of two, of about ``RANGE`` bytes of
text each, however much text there is.

This is the join of exploded n-grams with count tables, its rows packed: a row
of (block, order, range) stands for the sorted keys of all n-grams that they
have in common. Keys travel as gaps and totals as byte planes, compressed; one
row per n-gram would shuffle some ten times as much.

The score of word i, with the longest context of at most ``order - 1`` words
that its document has before it, is count(context word) / count(context) if
other documents hold that n-gram; otherwise ``BACKOFF`` times the score with a
context shorter by one. Alone, a word scores max(count, 1) / words. A
document's own counts are left out of all of these, so that it cannot vouch for
itself. Logarithms are rounded to millionths, whose sums do not depend on order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LOW48, free_shuffles, packed, range_bits, range_of, ranged, release, table, unpacked

BACKOFF = 0.4
#: Bytes of text in a block, and behind one range of a count table.
BLOCK, RANGE = 3 << 20, 16 << 20


def micro(x) -> np.ndarray:
    """Millionths of the natural logarithm, rounded."""
    return np.rint(1e6 * np.log(x)).astype(np.int64)


class Grams:
    """The n-grams of a block's documents: by order (from ``least``) the distinct tags, sorted, their counts, and each word's place among them."""

    def __init__(self, texts: list[bytes], order: int, bits: int, least: int = 1):
        each = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in each], dtype=np.int64)
        total = int(self.sizes.sum())
        word = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in each for x in w), dtype=np.uint64, count=total)
        self.doc = np.repeat(np.arange(len(each)), self.sizes)
        #: Words before each word in its document.
        self.before = np.arange(total) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.tags, self.counts, self.place = [], [], []
        h = word.copy()
        for k in range(1, order + 1):
            if k > 1:
                older = np.append(np.zeros(k - 1, dtype=np.uint64), word[: max(0, total - k + 1)])[:total]
                h = (h ^ (older * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(33)
            if k < least:
                continue
            tag = ranged(h, bits)
            has = self.before >= k - 1
            tags, inverse, counts = np.unique(tag[has], return_inverse=True, return_counts=True)
            place = np.full(total, -1)
            place[has] = inverse
            self.tags.append(tags)
            self.counts.append(counts)
            self.place.append(place)

    def own(self, k: int) -> np.ndarray:
        """For each word, how often its own document holds its n-gram of order k (0 without one)."""
        place = self.place[k - 1]
        has = place >= 0
        key = self.doc[has] * (len(self.tags[k - 1]) + 1) + place[has]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out = np.zeros(len(place), dtype=np.int64)
        out[has] = counts[inverse]
        return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (ids as text, sizes, texts compressed), of about BLOCK bytes."""
    pack = zstandard.ZstdCompressor(level=1)
    ids, texts, size = [], [], 0

    def block() -> pd.DataFrame:
        sizes = np.array([len(t) for t in texts], dtype="<u8").tobytes()
        return pd.DataFrame({"ids": [list(ids)], "sizes": [sizes], "texts": [pack.compress(b"".join(texts))]})

    for b in batches:
        for key, text in zip(b["id"], b["text"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if ids and size + len(data) > BLOCK:
                yield block()
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(data)
            size += len(data)
    if ids:
        yield block()


def _texts(sizes: bytes, blob: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, dtype="<u8")).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(ends[-1]) + 1)
    return [data[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]


def _ask(batches: Iterator[pd.DataFrame], k: int, bits: int) -> Iterator[pd.DataFrame]:
    """A block's distinct n-grams of order k and counts, by range: (part, block, number, gaps of the sorted tags, counts)."""
    for b in batches:
        for r in b.itertuples(index=False):
            g = Grams(_texts(r.sizes, r.texts), k, bits, least=k)
            tags, counts, rows = g.tags[0], g.counts[0], []
            which, at = np.unique(range_of(tags, bits), return_index=True)
            for p, a, z in zip(which.tolist(), at, np.append(at, len(tags))[1:], strict=True):
                gaps = np.diff(tags[a:z] & LOW48 if bits < 16 else tags[a:z], prepend=np.uint64(0))
                rows.append((p, r.block, int(z - a), packed(gaps), packed(counts[a:z])))
            yield pd.DataFrame(rows, columns=["part", "block", "n", "keys", "counts"])


def _add_up(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Totals of one range, for each block in the order of its keys."""
    sizes = rows["n"].to_numpy()
    tags = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) for x, n in zip(rows["keys"], sizes, strict=True)])
    counts = np.concatenate([unpacked(x, n) for x, n in zip(rows["counts"], sizes, strict=True)]).astype(np.float64)
    tags, inverse = np.unique(tags, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(tags)).astype(np.uint64)[inverse]
    each = zip(rows["block"], sizes, np.split(total, np.cumsum(sizes)[:-1]), strict=True)
    return pd.DataFrame([(block, k, int(rows["part"].iloc[0]), int(n), packed(t)) for block, n, t in each], columns=["block", "k", "part", "n", "totals"])


def _score(blocks: pd.DataFrame, answers: pd.DataFrame, order: int, bits: int, words: int) -> pd.DataFrame:
    r = blocks.iloc[0]
    g = Grams(_texts(r["sizes"], r["texts"]), order, bits)
    answers = answers.sort_values(["k", "part"])
    left = []
    for k in range(1, order + 1):
        mine = answers[answers["k"] == k]
        total = np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(t, n).astype(np.int64) for t, n in zip(mine["totals"], mine["n"], strict=True))])
        count = np.zeros(len(g.doc), dtype=np.int64)
        has = g.place[k - 1] >= 0
        count[has] = total[g.place[k - 1][has]]
        left.append(count - g.own(k))
    others = words - g.sizes[g.doc]
    level = np.minimum(g.before + 1, order)
    score = np.zeros(len(g.doc), dtype=np.int64)
    open_ = np.ones(len(g.doc), dtype=bool)
    back = np.zeros(len(g.doc), dtype=np.int64)
    for k in range(order, 1, -1):
        here = open_ & (level >= k)
        hit = here & (left[k - 1] > 0)
        context = np.append(0, left[k - 2][:-1])
        score[hit] = back[hit] + micro(left[k - 1][hit] / context[hit])
        back[here & ~hit] += int(micro(BACKOFF))
        open_ &= ~hit
    score[open_] = back[open_] + micro(np.maximum(left[0][open_], 1) / np.maximum(others[open_], 1))
    seen = np.bincount(g.doc, weights=~open_, minlength=len(g.sizes)).astype(np.int64)
    total = np.zeros(len(g.sizes), dtype=np.int64)
    np.add.at(total, g.doc, score)
    return pd.DataFrame({"id": list(r["ids"]), "n_words": g.sizes, "n_seen": seen, "score_micro": total})


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """One row per row of ``docs``: id (long), n_words, n_seen (words scored with a context),
    score_micro (sum of millionths of natural logarithms), mean_score (nats a word, null without words).

    Null and empty texts have no words and a score of 0. Rows that repeat are
    documents of their own. A null id stays null. In a corpus of one document
    each word scores 1 / 1. A very long text is a block of its own, in one task.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = source.mapInPandas(_blocks, "ids array<string>, sizes binary, texts binary")
    # The texts are compressed already.
    blocks = table(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [_texts(r.sizes, r.texts) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"n": [sum(len(t.split()) for t in ts) for ts in texts], "size": [sum(map(len, ts)) for ts in texts]})

    words, size = blocks.select("sizes", "texts").mapInPandas(sized, "n long, size long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = range_bits(size, RANGE)

    def summed(k: int) -> DataFrame:
        """The totals that each block asked for, of one order: what is shuffled of an order goes before the next comes."""
        asked = blocks.select("block", "sizes", "texts").mapInPandas(lambda it: _ask(it, k, bits), "part long, block long, n long, keys binary, counts binary")
        out = table(asked.groupBy("part").applyInPandas(lambda rows: _add_up(rows, k), "block long, k int, part long, n long, totals binary"), "totals")
        free_shuffles(spark)
        return out

    tables = [summed(k) for k in range(1, order + 1)]
    totals = reduce(DataFrame.unionByName, tables)
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(lambda b, t: _score(b, t, order, bits, words), "id string, n_words long, n_seen long, score_micro long")
    scored = table(scored, "scores")
    release(*tables, blocks)
    free_shuffles(spark)
    mean = F.when(F.col("n_words") > 0, F.col("score_micro") / 1e6 / F.col("n_words"))
    return scored.select(F.col("id").cast("long").alias(id_col), "n_words", "n_seen", "score_micro", mean.alias("mean_score"))
