"""Quality rules with robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated three-word
windows over whole texts. Documents that pass them are judged by language and
source: their transformed statistics are compared with a minimum-covariance-
determinant estimate of location and scatter of that group, and rejected when
the Mahalanobis distance is beyond a chi-square quantile.

The estimate is a deterministic MCD: from fixed starts, concentration steps
recompute mean and covariance over the ``support`` share of the group that is
nearest, until no determinant moves by more than 2 % (25 steps at most), and the
start with the smallest is refined. Covariances
are regularised towards the pooled one (weight ``prior`` rows) and floored, so
that one formula serves groups of any size, constant statistics included. In
the verdict a floor is the least variance, not an addition to it.

DataFrame functions only. A group is reduced to sums and to counts in
logarithmic distance bins, both aggregated before the shuffle, so that a group
with a third of all rows costs what the others do. The subset of a step is all
rows up to the bin in which the order statistic lies (bins of 1/32 octave).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import key_of, release, row_key, table, words

SYMBOLS = r"[#*$%&|<>]"
STATS = ["x1", "x2", "x3", "x4", "x5"]
D = len(STATS)
#: Floors on the standard deviations: log words, log mean word length, share of symbols, of repeated lines, of repeated words.
#: Most texts have none of the last three, so that no scatter of their own would tell some from much; length alone is no fault.
FLOORS = (1.0, 0.08, 0.012, 0.09, 0.08)
#: Lines and words without a repeat that are added to each text: one repeated line of two is no half.
PRIOR_LINES, PRIOR_WORDS = 10, 50
#: Concentration ends when no group's log-determinant moves by more: 0.2 % of a standard deviation. Shrinkage may leave a
#: small group between two subsets, which no number of steps would settle.
STILL = 0.02
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def base_statistics(text: Column) -> dict[str, Column]:
    """The base columns of a text; a null text has no words, symbols or lines.

    Arrays are bound once (``let``), as a lambda that names a computed array
    would compute it again for each element.
    """
    t = F.coalesce(text, F.lit(""))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def repeated(w: Column) -> Column:
        """Words in windows that occur again: sort (window, place), keep neighbours that agree, count covered places."""
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))

        def covered(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
            again = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.array_sort(windows), covered)).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words"))

    def dup_lines(lines: Column) -> Column:
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"))

    worded = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "w": let(words(text), of_words),
        "l": let(worded, dup_lines),
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
    }


def _vector() -> dict[str, Column]:
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "x1": F.log1p(F.col("n_words").cast("double")),
        "x2": F.log(c / n),
        "x3": F.col("n_symbols") / c,
        "x4": F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES),
        "x5": F.col("n_repeat_words") / (n + PRIOR_WORDS),
    }


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, means m and covariances c (upper triangle) by group."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s_{x}") for x in STATS]
    sums += [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q_{i}_{j}") for i, j in PAIRS]
    out = rows.groupBy(*keys).agg(*sums)
    m = [F.col(f"s_{x}") / F.col("n") for x in STATS]
    cov = [F.col(f"q_{i}_{j}") / F.col("n") - m[i] * m[j] for i, j in PAIRS]
    return out.select(*keys, "n", F.array(*m).alias("m"), F.array(*cov).alias("c"))


def _estimates(moments: DataFrame, by: list[str], prior: float, factor: float | None = None) -> DataFrame:
    """Regularised location, precision (row-major) and log-determinant by group.

    The pooled covariance is the mean of the groups' own, weighted by rows;
    ``by`` names what is pooled apart (the start of the estimate). The search
    for the nearest rows adds the floors to the variances. With ``factor``, for
    the verdict, covariances are that much larger and a floor is the least that
    a variance may be; correlations are shrunk by ``prior`` rows of all, and by
    a hundredth at least, which keeps the matrix positive definite.
    """
    pool = moments.groupBy(*by).agg(
        F.array(*[F.sum(F.get("c", F.lit(k)) * F.col("n")) / F.sum("n") for k in range(len(PAIRS))]).alias("pc"),
        F.array(*[F.sum(F.get("m", F.lit(k)) * F.col("n")) / F.sum("n") for k in range(D)]).alias("pm"),
        F.sum("n").alias("pn"),
    )
    # Rows: one for each start.
    mixed = moments.join(F.broadcast(pool), by)
    share = F.col("n") / (F.col("n") + F.lit(prior))
    blend = lambda a, b: F.zip_with(a, b, lambda x, y: x * share + y * (F.lit(1.0) - share))
    mixed = mixed.withColumns({"m": blend("m", "pm"), "c": blend("c", "pc")}).drop("pm", "pc")
    tied = F.least(F.col("pn") / (F.col("pn") + F.lit(prior)), F.lit(0.99))
    at = {p: k for k, p in enumerate(PAIRS)}

    def entry(i: int, j: int) -> Column:
        c = F.get("c", F.lit(at[min(i, j), max(i, j)]))
        if factor is not None:
            return F.greatest(c * F.lit(factor), F.lit(FLOORS[i] ** 2)) if i == j else c * F.lit(factor) * tied
        return F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else c

    augmented = F.array(*[F.array(*[entry(i, j) for j in range(D)], *[F.lit(1.0 if i == j else 0.0) for j in range(D)]) for i in range(D)])

    def pivot(state: Column, k: Column) -> Column:
        """One Gauss-Jordan step; the matrix is positive definite, so pivots need no search."""
        row = F.get(state["a"], k)
        lead = F.get(row, k)
        unit = F.transform(row, lambda x: x / lead)
        a = F.transform(state["a"], lambda r, i: F.when(i == k, unit).otherwise(F.zip_with(r, unit, lambda x, u: x - F.get(r, k) * u)))
        return F.struct(a.alias("a"), (state["ld"] + F.log(lead)).alias("ld"))

    start = F.struct(augmented.alias("a"), F.lit(0.0).alias("ld"))
    solved = mixed.withColumn("solved", F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), start, pivot))
    return solved.select(*[c for c in moments.columns if c not in ("n", "m", "c")], "m", F.flatten(F.transform("solved.a", lambda r: F.slice(r, D + 1, D))).alias("p"), F.col("solved.ld").alias("ld"))


def _distance() -> Column:
    """The squared Mahalanobis distance of x1.. to (m, p)."""
    e = [F.col(STATS[i]) - F.get("m", F.lit(i)) for i in range(D)]
    terms = [e[i] * e[j] * F.get("p", F.lit(i * D + j)) * F.lit(1.0 if i == j else 2.0) for i, j in PAIRS]
    return reduce(lambda a, b: a + b, terms)


def _step(rows: DataFrame, fitted: DataFrame, support: float, prior: float, factor: float | None = None) -> DataFrame:
    """A concentration step for each (group, start) of ``fitted``."""
    keys = ["g", "start"]
    near = rows.join(fitted, "g").withColumn("bin", F.floor(F.log2(_distance() + F.lit(1e-12)) * 32).cast("int")).select(*keys, "bin", *STATS)
    bins = near.groupBy(*keys, "bin").count()
    w = Window.partitionBy(*keys)
    upto = bins.withColumns({"upto": F.sum("count").over(w.orderBy("bin")), "all": F.sum("count").over(w)})
    limit = upto.where(F.col("upto") >= F.ceil(F.col("all") * support)).groupBy(*keys).agg(F.min("bin").alias("limit"))
    return _estimates(_moments(near.join(limit, keys).where("bin <= limit"), keys), ["start"], prior, factor)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", support: float = 0.75, cutoff: float = 0.999, prior: float = 50.0, steps: int = 25) -> DataFrame:
    """One row per row of ``docs``: id, the base statistics, base_failed, distance, kept.

    base_failed: fewer than 50 words, or over half the words in three-word
    windows that occur again. Of the others, ``kept`` is false beyond the
    ``cutoff`` quantile. Null languages and sources are groups of their own; a
    null text has no words and fails; a group of one row is judged by the
    pooled scatter around its own shrunken location. Rows that repeat are judged
    alike. A very long text is one array of its words in one task. An empty table
    gives an empty result. Other columns are not read.
    """
    stats = docs.select(F.col(id_col).alias("id"), F.concat_ws("\x00", key_of(F.col(lang_col)), key_of(F.col(source_col))).alias("g"), *[c.alias(n) for n, c in base_statistics(F.col(text_col)).items()])
    stats = stats.select("id", "g", "w.*", "l.*", "word_chars", "n_symbols")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = table(stats.withColumn("base_failed", failed).withColumns(_vector()), "statistics")
    rows = stats.where("not base_failed").select("g", *STATS)

    first = _moments(rows, ["g"])
    inner = reduce(lambda a, b: a & b, [F.abs(F.col(x) - F.get("m", F.lit(i))) <= 1.5 * F.sqrt(F.greatest(F.get("c", F.lit(PAIRS.index((i, i)))), F.lit(0.0))) + F.lit(FLOORS[i]) for i, x in enumerate(STATS)])
    first = table(first, "moments")
    central = _moments(rows.join(first.select("g", "m", "c"), "g").where(inner), ["g"])
    start = first.withColumn("start", F.lit(0)).unionByName(central.withColumn("start", F.lit(1)))
    fitted = table(_estimates(start, ["start"], prior), "fitted")
    for _ in range(steps):
        new = table(_step(rows, fitted.drop("ld"), support, prior), "fitted")
        moved = new.join(fitted.select("g", "start", F.col("ld").alias("old")), ["g", "start"]).agg(F.max(F.abs(F.col("ld") - F.col("old")))).first()[0]
        release(fitted)
        fitted = new
        if moved is None or moved < STILL:
            break
    best = fitted.groupBy("g").agg(F.min_by(F.struct("start", "m", "p"), F.struct("ld", "start")).alias("b")).select("g", "b.*")
    # The covariance of the nearest share of a normal sample is too small by this factor.
    factor = support / chi2_cdf(chi2_quantile(support, D), D + 2)
    best = table(_step(rows, best, support, prior, factor), "fitted").select("g", "m", "p")
    judged = stats.join(best, "g", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= F.lit(chi2_quantile(cutoff, D)))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """``docs`` without the rows that :func:`quality` rejects; all columns stay.

    Each row has a verdict of its own, also where its identifier is null or repeated.
    """
    named = docs.withColumn("_quality_row", row_key(*[F.col(c) for c in (id_col, text_col, lang_col, source_col)]))
    kept = quality(named, "_quality_row", text_col, lang_col, source_col, **how).where("kept").select("_quality_row").distinct()
    out = named.join(kept, "_quality_row", "left_semi")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
