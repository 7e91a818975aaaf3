"""Best-fit packing of token pieces into fixed-length sequences.

Pattern packing by non-negative least squares: all multisets of at most
``max_parts`` lengths that fill a sequence exactly are enumerated; their repeat
counts are fitted to the histogram of piece lengths with x >= 0 (accelerated
projected gradient); counts are rounded down, as far as the histogram allows; what is
left is packed best-fit-decreasing, group-wise on the histogram. All of that
sees only the histogram, whose size is the sequence length, so the driver's
work does not depend on the number of documents.

Pieces then get a rank within their length (dealt over tasks by
:func:`brindle.llm.common.running_total`, so a very common length is no hot
spot), and the rank picks the place that the plan has for it. The plan has at
most ``max_parts`` entries a pattern plus the residual's, all bounded by the
sequence length; that is what is sent to executors.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import hex_digits, running_total, table


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, as a tiktoken encoding.

    Same vocabulary, merge order and pre-tokenising pattern, hence the same
    ids, at about five times the speed on one core. Strings of added tokens
    in a text are ordinary text here; :func:`encode` splits at them.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Printable bytes stand for themselves; the others, in order, for code points from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def plain_bytes(path: str) -> bool:
    """Whether the file is a byte-level BPE without anything that :func:`encoder` leaves out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or spec.get("normalizer") is not None:
        return False
    if not before.get("use_regex", True) or before.get("add_prefix_space", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    # Merges in the order of their results' ids, which is the order of ranks.
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return all(x < y for x, y in zip(ids, ids[1:], strict=False)) and min(ids, default=0) >= 0


@lru_cache(maxsize=4)
def whole(path: str, added: bool):
    """The ``tokenizers`` file itself; without ``added`` the strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not added
    return tok


@lru_cache(maxsize=4)
def splitter(path: str) -> tuple[re.Pattern | None, dict[str, int], bool]:
    """A pattern of the file's added tokens, their ids, and whether they are found by their strings alone."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    plain = not any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    longest = sorted((t["content"] for t in tokens), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, longest))) if tokens else None, {t["content"]: t["id"] for t in tokens}, plain


#: A run of white space that is left to ``tokenizers``: tiktoken backtracks over it, and fails on very long ones.
LONG_SPACE = re.compile(r"\s{1000}")


def encode(path: str, text: str, added: bool) -> list[int]:
    """The ids of ``text`` as ``tokenizers`` gives them without a post-processor's tokens; with ``added``,
    strings of the file's added tokens have their own ids."""
    pattern, ids, plain = splitter(path)
    if not plain_bytes(path) or LONG_SPACE.search(text) or (added and not plain):
        return whole(path, added).encode(text, add_special_tokens=False).ids
    enc = encoder(path)
    try:
        if not added or pattern is None or not pattern.search(text):
            return enc.encode_ordinary(text)
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [*enc.encode_ordinary(text[at : m.start()]), ids[m[0]]]
            at = m.end()
        return out + enc.encode_ordinary(text[at:])
    except BaseException as e:  # noqa: BLE001  tiktoken's regular expressions may give up on a text, with a panic of Rust
        if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
            raise
        return whole(path, added).encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int, with_ids: bool, added: bool = True) -> DataFrame:
    """Token pieces of every document: its ids, then ``end_id``, cut from the back into ``length``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.array([*encode(tokenizer, text, added), end_id], dtype="<u4")
                head = (len(ids) - 1) % length + 1
                edges = [0, *range(head, len(ids) + 1, length)]
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[a:b].tobytes()
                    rows.append((k, n, a, b - a, zlib.crc32(part), part if with_ids else None))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.struct(F.col(id_col)).alias("key"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Identifiers travel as JSON text: pandas would turn a column of longs with a null into doubles.
    src = src.select(F.to_json("key").alias("id"), "text")
    out = src.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long, ids binary")
    back = F.from_json("id", f"`{id_col}` {kind}")[id_col]
    # With a row number, so that rows that are wholly equal are not one key.
    out = out.withColumn("tick", F.md5(F.concat_ws(":", "id", "piece", "ids_crc32", F.monotonically_increasing_id()))).withColumn("id", back)
    return out if with_ids else out.drop("ids")


def patterns(length: int, max_parts: int, present: np.ndarray) -> np.ndarray:
    """Rows of non-increasing parts (0: none) that sum to ``length``, of lengths that are present."""
    out = []

    def extend(head: list[np.ndarray], left: np.ndarray, top: np.ndarray, parts: int) -> None:
        done = (left > 0) & (left <= top) & present[np.clip(left, 0, length)]
        if done.any():
            rows = [h[done] for h in head] + [left[done]]
            rows += [np.zeros(done.sum(), dtype=np.int64)] * (max_parts - len(rows))
            out.append(np.stack(rows, 1))
        if parts > 1:
            sizes = np.flatnonzero(present)
            # The next part is at most the one before, and at least an even share of what is left.
            a, b = np.meshgrid(np.arange(len(left)), sizes, indexing="ij")
            a, b = a.ravel(), b.ravel()
            ok = (b <= top[a]) & (b < left[a]) & (b * parts >= left[a])
            a, b = a[ok], b[ok]
            if len(a):
                extend([*(h[a] for h in head), b], left[a] - b, b, parts - 1)

    extend([], np.array([length]), np.array([length]), max_parts)
    return np.concatenate(out) if out else np.zeros((0, max_parts), dtype=np.int64)


#: Exponent of the weight of a length in the fit.
POWER = 1.0


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W (A x - counts)|^2, A[l, p] being how often pattern p has length l.

    Weights grow with the length: a long piece that is left over costs a sequence, a short one fills a gap.
    """
    n = len(counts)
    weight = (np.arange(n) / (n - 1)) ** POWER

    def used(x: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        for j in range(rows.shape[1]):
            total += np.bincount(rows[:, j], weights=x, minlength=n)
        total[0] = 0
        return total

    gather = lambda r: (weight * weight * r)[rows].sum(1)
    v = np.ones(len(rows))
    for _ in range(30):
        v = gather(used(v))
        v /= np.linalg.norm(v)
    lip = float(v @ gather(used(v))) * 1.05
    goal = counts.astype(float)
    goal[0] = 0
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - gather(used(y) - goal) / lip, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: np.ndarray, max_parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences and how many have them; ``counts[l]`` pieces of length l, all used exactly once."""
    length = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    rows = patterns(length, max_parts, left > 0)
    if len(rows):
        x = fit(rows, left)
        for p in np.argsort(-x, kind="stable"):
            if (want := int(x[p])) <= 0:
                break
            parts = tuple(int(v) for v in rows[p] if v)
            want = min(want, *(int(left[v]) // parts.count(v) for v in parts))
            if want > 0:
                out.append((parts, want))
                for v in parts:
                    left[v] -= want
    # Best fit decreasing on groups of equal sequences: free[f] holds groups with f tokens of room.
    free: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]
    for v in range(length, 0, -1):
        n, f = int(left[v]), v
        while n and f <= length:
            if not free[f]:
                f += 1
                continue
            parts, have = free[f].pop()
            m = min(n, have)
            if have > m:
                free[f].append((parts, have - m))
            free[f - v].append(((*parts, v), m))
            n -= m
            f = v if f - v >= v else f
        q = length // v
        if n // q:
            free[length - q * v].append(((v,) * q, n // q))
        if n % q:
            free[length - n % q * v].append(((v,) * (n % q), 1))
    return out + [g for groups in free for g in groups]


def places(contents: list[tuple[tuple[int, ...], int]], length: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), by rank; ranks follow one another without gaps."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks, sequence = [0] * (length + 1), 0
    for parts, n in contents:
        offset = 0
        for v in parts:
            rows.setdefault(v, []).append((ranks[v], sequence, offset))
            ranks[v] += n
            offset += v
        sequence += n
    return {v: np.array(r, dtype=np.int64) for v, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2, max_parts: int = 3, with_ids: bool = True, added: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) if ``with_ids``.

    With ``added``, strings of the tokenizer file's added tokens have their own
    ids, as ``tokenizers`` gives them at its defaults; else they are ordinary text.
    Null and empty texts are one end token. Rows that repeat, or whose
    identifier is null, are packed as documents of their own. A very long text is
    one list of ids in one task. An empty table gives an empty result. Other
    columns are not read. ``max_parts``, the parts of a pattern, and the steps of
    the fit are parameters of the method: any value packs all pieces.
    """
    cut = table(pieces(docs, tokenizer, id_col, text_col, length, end_id, with_ids, added), "pieces")
    counts = np.zeros(length + 1, dtype=np.int64)
    for v, n in cut.groupBy("length").count().collect():  # at most ``length`` rows
        counts[v] = n
    where = places(plan(counts, max_parts), length)
    one = cut.withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(one, ["length"], ["tick", "id"], "one", "rank", hex_digits(int(counts.sum()))).drop("one", "tick")

    lookup = F.pandas_udf(_placer(where), "struct<sequence_id:long,offset:long>")
    out = ranked.withColumn("at", lookup("length", "rank"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def _placer(where: dict[int, np.ndarray]):
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for v in np.unique(n):
            at, rows = np.flatnonzero(n == v), where[int(v)]
            k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
            seq[at] = rows[k, 1] + rank[at] - rows[k, 0]
            off[at] = rows[k, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return place
