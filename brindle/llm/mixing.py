"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], given as
values at equally spaced knots and linear between them. The schedule's integral
is the source's weight. Targets share all words by weight, capped at
``max_repeats`` times a source's size, the excess reshared by weight. A
source's documents are then consumed in a fixed pseudo-random order, in passes;
the cumulative demand of its schedule, scaled to its target, is inverted at the
middle of each taken piece to give the piece's training position, and documents
are range-sorted by position.

DataFrame functions only. The table of sources is the only thing that one task
sees whole; documents of a hot source are dealt over many tasks
(:func:`brindle.llm.common.running_total`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import hex_digits, key_of, n_words, row_key, running_total, table

#: Schedules by rank of the source, repeating. Integrals 1, 2 and 3: the first
#: kind fades out, the second holds, the third is annealed in.
SCHEDULES = ((1.5, 0.5), (2.0, 2.0), (1.5, 4.5))


def integral(knots: tuple[float, ...]) -> float:
    """The trapezoid integral over [0, 1]."""
    return sum((a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)) / (len(knots) - 1)


def targets(sizes: DataFrame, schedules=SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """Adds rank, weight and target to ``sizes`` (source_key, source, source_size).

    Sources rank by code point, null last. The water level L, words per unit
    of weight, solves sum(min(max_repeats * size, L * weight)) = all words;
    with sources in order of cap per weight it is the first L at which the
    sources below are exactly those that are capped.
    """
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.get(weights, F.pmod("rank", F.lit(len(schedules)))))
    t = t.withColumn("cap", F.col("source_size") * max_repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    t = t.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_left": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # The first source (by cap per weight) whose cap is above the level fixes it; without one all are capped.
    free = F.col("cap") > F.col("level") * F.col("weight")
    fixed = F.min_by(F.when(free, F.struct("cap_before", "weight_left")), F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(Window.partitionBy())
    t = t.withColumn("fixed", fixed)
    share = F.col("weight") * (F.col("total") - F.col("fixed.cap_before")) / F.col("fixed.weight_left")
    return t.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), share), F.col("cap").cast("double"))).drop("cap", "cap_before", "weight_left", "total", "level", "fixed")


def position(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` (0 to 1) of its whole.

    Within a segment of length d from weight a to weight b the demand is
    a u + (b - a) u^2 / (2 d); the inverse takes the root in the form that
    has no cancellation and holds for a = b too.
    """

    def inverse(knots: tuple[float, ...]) -> Column:
        d, whole = 1.0 / (len(knots) - 1), integral(knots)
        at, before, out = 0.0, 0.0, None
        for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            need = share * F.lit(whole) - F.lit(before)
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / d) * need, F.lit(0.0)))
            here = F.lit(at) + F.least(F.lit(2.0) * need / (F.lit(a) + root), F.lit(d))
            part = (a + b) / 2 * d
            last = i == len(knots) - 2
            step = F.when(F.lit(True) if last else need <= part, here)
            out = step if out is None else F.coalesce(out, step)
            at, before = at + d, before + part
        return out

    out = None
    for i, knots in enumerate(schedules):
        hit = F.when(F.pmod(rank, F.lit(len(schedules))) == i, inverse(knots))
        out = hit if out is None else F.coalesce(out, hit)
    return out


def _sizes(ident: Column, text: Column, source: Column) -> list[Column]:
    source = source.cast("string")
    return [ident.alias("id"), key_of(source).alias("source_key"), source.alias("source"), n_words(text).alias("size")]


def unnamed(row: Column) -> Column:
    """A key of a row without an identifier: its digest and a part of its place, so that equal rows are many keys."""
    return F.concat(row, F.lit(":"), (F.monotonically_increasing_id() % 4096).cast("string"))


def _plan(sizes: DataFrame, order: list[str], schedules, max_repeats: int) -> DataFrame:
    """``sizes`` (id, source_key, source, size and all of ``order``), with source_size, target and passes."""
    sizes = table(sizes, "sizes")
    rows = sizes.count()
    per_source = targets(sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), schedules, max_repeats)
    per_source = per_source.select("source_key", "source_size", "target", "rank")
    placed = running_total(sizes, ["source_key"], order, "size", "before", hex_digits(rows), per_source)
    goal = F.round("target").cast("long")
    whole = F.floor(goal / F.col("source_size")).cast("long")
    rest = goal - whole * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    placed = placed.withColumns({"goal": F.when(F.col("source_size") > 0, goal).otherwise(0), "whole": F.when(F.col("source_size") > 0, whole).otherwise(0), "last": F.when(F.col("source_size") > 0, last).otherwise(0)})

    def one(k: int) -> Column:
        """Pass k: its words, and the position of their middle in the source's demand."""
        n = F.when(F.lit(k) < F.col("whole"), F.col("size")).when(F.lit(k) == F.col("whole"), F.col("last")).otherwise(0)
        middle = F.lit(k) * F.col("source_size") + F.col("before") + n / 2
        return F.struct(F.lit(k).alias("pass"), n.cast("long").alias("words"), position(middle / F.col("goal"), F.col("rank"), schedules).alias("position"))

    return placed.withColumn("passes", F.filter(F.array(*[one(k) for k in range(max_repeats)]), lambda p: p["words"] > 0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """What the mix takes of each row of ``docs``, range-sorted by first position.

    Columns: id, size, source_size, target, taken, position, passes: an array
    of (pass, words, position). A pass takes all words of a document but for
    the last pass of a source, which stops at the very word that meets the
    target (targets are rounded to whole words). Size is the number of words;
    null texts have 0. Rows of equal identifier keep a fixed relative order
    only up to their equality. A very long text is counted in one task. An empty
    table gives an empty result. All-zero sizes give targets of 0. Other columns
    are not read. Sources are few: their table is sorted in one task.
    """
    ident, text, source = F.col(id_col), F.col(text_col), F.col(source_col)
    sizes = docs.select(*_sizes(ident, text, source), F.md5(F.coalesce(ident.cast("string"), unnamed(row_key(ident, text, source)))).alias("tick"))
    plan = _plan(sizes, ["tick", "id", "size"], schedules, max_repeats)
    plan = plan.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"),
        F.get("passes", F.lit(0))["position"].alias("position"),
        "passes",
    )
    return plan.orderBy(F.col("position").asc_nulls_last(), id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """The mix: rows of ``docs`` in training order, each as often as it is taken; all columns stay.

    The one cut piece of each source keeps its first words and the white space
    between them. Each row follows a plan of its own, also where identifiers are
    null or repeated; with unique identifiers it is that of :func:`mix_plan`.
    """
    ident, text, source = F.col(id_col), F.col(text_col), F.col(source_col)
    row = row_key(ident, text, source)
    sizes = docs.select(*_sizes(ident, text, source), F.md5(F.coalesce(ident.cast("string"), unnamed(row))).alias("tick"), row.alias("_mix_row"))
    plan = _plan(sizes, ["tick", "id", "size", "_mix_row"], schedules, max_repeats)
    plan = table(plan.select("_mix_row", F.col("size").alias("_mix_size"), F.col("passes").alias("_mix_passes")), "plan")
    named = docs.withColumn("_mix_row", row)
    again = plan.groupBy("_mix_row").count().where("count > 1").select("_mix_row")
    if again.isEmpty():
        out = named.join(plan, "_mix_row")
    else:
        # Equal rows have plans of their own: both are numbered, and numbers meet.
        again = table(again, "again")

        def numbered(rows: DataFrame) -> DataFrame:
            rows = rows.join(again, "_mix_row", "left_semi").withColumns({"_mix_at": F.monotonically_increasing_id(), "_mix_one": F.lit(1).cast("long")})
            rows = table(rows.withColumn("_mix_tick", F.md5(F.col("_mix_at").cast("string"))), "repeated")
            return running_total(rows, ["_mix_row"], ["_mix_tick", "_mix_at"], "_mix_one", "_mix_n", hex_digits(rows.count())).drop("_mix_at", "_mix_one", "_mix_tick")

        out = named.join(plan.join(again, "_mix_row", "left_anti"), "_mix_row")
        out = out.unionByName(numbered(named).join(numbered(plan), ["_mix_row", "_mix_n"]).drop("_mix_n"))
    out = out.withColumn("_mix", F.explode("_mix_passes"))
    kept = F.array_join(F.slice(F.split(F.regexp_replace(F.col(text_col), r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.col("_mix.words").cast("int")), "")
    out = out.withColumn(text_col, F.when(F.col("_mix.words") == F.col("_mix_size"), F.col(text_col)).otherwise(kept))
    return out.repartitionByRange(F.col("_mix.position")).sortWithinPartitions("_mix.position", "_mix_row").select(*[F.col(f"`{c}`") for c in docs.columns])
