"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates r that take a source's target of words, sum(size * r) = target with 0 <= r <= 3, the balancing
picks those closest to "every document once" in entropy. They are exponential tilts
r = min(3, exp(lambda * class / mean)), one multiplier per source; the class is the size with eight leading bits. A
source's documents enter as sums by class, made where its rows lie, some thousand at most, and the Newton steps on the
convex dual, kept inside a bracket, run over these sums: all sources at once, each where its sums are. Rates become
copies by sequential Poisson rounding: whole parts are taken, and documents in the order of hash / fraction get one copy
more until the words left to take run out; a few documents of fitting size then close the gap per source.

All sums are of whole numbers and every fold over a source's classes is in their order, so reruns agree whatever the
order of rows and tasks.

Defined cases: null texts have size 0; documents of size 0 are taken once, for no words; a null source is a source of
its own, the last in order; sources without words get the target 0; rows that repeat a doc_id and text share one
decision; an empty table gives an empty result; columns other than doc_id, source and text are carried by `mixed`
only, which keeps names that begin with `__mix_` to itself. The plan has one row per source; a broadcast of it is
bounded, beyond that it is joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.positions import POS, position_by
from .common import BROADCAST_ROWS, checkpoint, radix_cut, sized, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
STEPS, PRECISE = 60, 1e-9
#: Leading bits of a size that make its class, and bits of a document's place in the order of rounding.
CLASS_BITS, PLACE_BITS = 8, 24
#: Documents of a class that may close a gap, which is below the size of one document in all but odd cases.
FILLERS = 8


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` of `docs` and each row's source, size, class and fixed draw of 48 bits."""
    sized_rows = docs.select(*keep, F.col("source").alias("__mix_source"), word_count("text").alias("__mix_size"), F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("mix")), 16).alias("__mix_draw"))
    low = f"greatest(length(bin(__mix_size)) - {CLASS_BITS}, 0)"
    return sized_rows.withColumn("__mix_class", F.expr(f"shiftleft(shiftright(__mix_size, {low}), {low})"))


def source_sums(rows: DataFrame) -> DataFrame:
    """Per source: source, source_size, and `classes`, its documents and words by class in order."""
    by_class = rows.groupBy("__mix_source", "__mix_class").agg(F.count(F.lit(1)).alias("n"), F.sum("__mix_size").alias("words"))
    classes = F.sort_array(F.collect_list(F.struct(F.col("__mix_class").alias("class"), "n", "words")))
    return by_class.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("words").alias("source_size"), classes.alias("classes"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`sources` (source, source_size), a table of its own, with `target`: weighted shares of all words.

    None is above MOST times its source. The common level of words per weight follows from closing, round by round, the
    sources that are below it; closed sums only grow, so it ends.
    """
    rank = position_by(sources.select("source", F.xxhash64("source").alias(POS)), [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col(POS) % len(weights) + 1).cast("int")).cast("long")
    weighted = checkpoint(rank.select(F.col("source").alias("__s"), weight.alias("weight")))
    rows = checkpoint(sources.join(weighted, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("limit", MOST * F.col("source_size")))
    total, closed, opened = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.lit(0), F.coalesce(F.sum("weight"), F.lit(0))).first()
    while opened:
        level = (total - closed) / opened
        under = F.col("limit") <= F.lit(level) * F.col("weight")
        found = rows.agg(F.coalesce(F.sum(F.when(under, F.col("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(~under, F.col("weight"))), F.lit(0))).first()
        if (closed, opened) == tuple(found):
            break
        closed, opened = found
    common = F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight")) if opened else F.col("limit").cast("double")
    return rows.select(*sources.columns, common.alias("target"))


def _rate(lam: Column | str, size: Column | str, mean: Column | str) -> str:
    return f"least({MOST}D, exp(least({lam} * {size} / {mean}, 2D)))"


def balanced(targets: DataFrame) -> DataFrame:
    """`targets` (source, source_size, classes, target) with the mean size and the multiplier `lam` of each source.

    A source whose target is its limit gets the multiplier at which all its documents reach MOST copies.
    """
    some = F.expr("filter(classes, c -> c.words > 0)")
    state = targets.withColumn("classes", some).select("source", "source_size", "classes", "target", F.expr("source_size / aggregate(classes, 0L, (a, c) -> a + c.n)").alias("mean"))
    ratio, widest = "target / source_size", "mean / classes[0].class"
    begin = f"""named_struct('lam', 0D, 'low', IF({ratio} < 1, ln(greatest({ratio}, 1e-300)) * {widest}, 0D),
        'high', IF({ratio} > 1, ln({MOST}D) * {widest}, 0D), 'done', {ratio} >= {MOST * (1 - PRECISE)}D)"""
    sums = f"""aggregate(classes, named_struct('taken', 0D, 'slope', 0D), (a, c) -> named_struct(
        'taken', a.taken + c.words * {_rate('s.lam', 'c.class', 'mean')},
        'slope', a.slope + IF({_rate('s.lam', 'c.class', 'mean')} < {MOST}, c.words * {_rate('s.lam', 'c.class', 'mean')} * c.class / mean, 0D)))"""
    # Bound names by one-element arrays: the sums t, then the bracket b after them.
    bracket = "named_struct('low', IF(t.taken < target, s.lam, s.low), 'high', IF(t.taken > target, s.lam, s.high), 'step', s.lam - (t.taken - target) / t.slope)"
    moved = "named_struct('lam', IF(b.step > b.low AND b.step < b.high, b.step, (b.low + b.high) / 2), 'low', b.low, 'high', b.high, 'done', false)"
    arrived = f"abs(t.taken - target) <= {PRECISE}D * greatest(target, 1D)"
    after = f"IF({arrived}, named_struct('lam', s.lam, 'low', s.low, 'high', s.high, 'done', true), transform(array({bracket}), b -> {moved})[0])"
    newton = f"aggregate(sequence(1, {STEPS}), {begin}, (s, k) -> IF(s.done, s, transform(array({sums}), t -> {after})[0]))"
    lam = F.expr(f"CASE WHEN size(classes) = 0 THEN NULL WHEN {ratio} >= {MOST * (1 - PRECISE)}D THEN ln({MOST}D) * {widest} ELSE ({newton}).lam END")
    return state.select("source", "source_size", "target", "mean", lam.alias("lam"))


PLAN = ("source_size", "target", "mean", "lam", "cut", "gap", "fillers")


def _placed(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Measured `rows` with their source's plan, whole copies and place in the order of rounding, all named `__mix_...`."""
    named = plan.select(*(F.col(c).alias(f"__mix_{c}" if c != "source" else "__mix_s") for c in plan.columns))
    joined = rows.join(sized(named, small=small), F.col("__mix_source").eqNullSafe(F.col("__mix_s"))).drop("__mix_s")
    rate = F.when(F.col("__mix_lam").isNull() | (F.col("__mix_size") == 0), 1.0).otherwise(F.expr(_rate("__mix_lam", "__mix_class", "__mix_mean")))
    joined = joined.withColumn("__mix_rate", rate).withColumn("__mix_whole", F.floor(F.col("__mix_rate") + 1e-9))
    joined = joined.withColumn("__mix_part", F.greatest(F.col("__mix_rate") - F.col("__mix_whole"), F.lit(0.0)))
    # x / (1 + x) for x = draw / fraction: in [0, 1) and in the same order, finest around the cut near x = 1.
    draw = (F.col("__mix_draw") + 0.5) / float(1 << 48)
    place = F.when(F.col("__mix_part") > 1e-9, draw / (draw + F.col("__mix_part")) * float(1 << PLACE_BITS)).otherwise(float((1 << PLACE_BITS) - 1))
    return joined.withColumn("__mix_place", place.cast("long"))


def _copies() -> Column:
    drawn = (F.col("__mix_place") < F.col("__mix_cut")) & (F.col("__mix_part") > 1e-9)
    filler = F.array_contains("__mix_fillers", F.col("__mix_draw"))
    return (F.col("__mix_whole") + F.when(drawn, 1).otherwise(0) + F.when(filler, 1).otherwise(0)).cast("long")


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, bool]:
    """One row per source of the measured `rows`, a table of its own: source and PLAN; and whether it is small."""
    sources = checkpoint(source_sums(rows))
    small = sources.count() <= BROADCAST_ROWS
    plan = checkpoint(balanced(source_targets(sources, weights)))
    placed = _placed(rows, plan, small)
    whole = placed.groupBy("__mix_source").agg(F.sum(F.col("__mix_whole") * F.col("__mix_size")).alias("whole"))
    left = (F.col("target") - F.coalesce("whole", F.lit(0))).alias("left")
    plan = checkpoint(plan.join(sized(whole, small=small), F.col("source").eqNullSafe(F.col("__mix_source")), "left").select("source", "source_size", "target", "mean", "lam", left))
    cuts = radix_cut(placed.filter("__mix_part > 1e-9 AND __mix_size > 0"), "__mix_source", "__mix_place", "__mix_size", plan.select(F.col("source").alias("__mix_source"), "left"), "left", PLACE_BITS, small)
    no_fillers = F.expr("CAST(array() AS array<bigint>)").alias("fillers")
    plan = plan.join(sized(cuts, small=small), F.col("source").eqNullSafe(F.col("__mix_source"))).select("source", "source_size", "target", "mean", "lam", "cut", (F.col("left") - F.col("below")).alias("gap"), no_fillers)
    plan = checkpoint(plan)
    return checkpoint(_filled(rows, plan, small)), small


def _filled(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """The plan with fillers: per source, large before small, documents that still fit into the gap, FILLERS of a class at most."""
    fits = _placed(rows, plan, small).withColumn("copies", _copies()).filter(f"__mix_size > 0 AND __mix_size <= __mix_gap AND copies < {MOST}")
    rank = F.row_number().over(Window.partitionBy("__mix_source", "__mix_class").orderBy("__mix_draw", "__mix_size"))
    # The limit on the rank cuts every task's rows before they are shuffled.
    first = fits.select("__mix_source", "__mix_class", "__mix_draw", "__mix_size", rank.alias("rank")).filter(F.col("rank") <= FILLERS)
    found = first.groupBy("__mix_source").agg(F.sort_array(F.collect_list(F.struct(F.col("__mix_size").alias("size"), F.col("__mix_draw").alias("draw"))), asc=False).alias("options"))
    chosen = F.expr(
        "aggregate(coalesce(options, array()), named_struct('gap', gap, 'fillers', CAST(array() AS array<bigint>)), "
        "(a, x) -> IF(x.size <= a.gap, named_struct('gap', a.gap - x.size, 'fillers', concat(a.fillers, array(x.draw))), a)).fillers"
    )
    joined = plan.drop("fillers").join(sized(found, small=small), F.col("source").eqNullSafe(F.col("__mix_source")), "left")
    return joined.select("source", *PLAN[:-1], chosen.alias("fillers"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target and copies."""
    rows = checkpoint(measured(docs, "doc_id"))
    placed = _placed(rows, *mixing_plan(rows, weights))
    return placed.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), _copies().alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of `docs`, all columns, each as often as it is taken; no text moves between tasks for it."""
    plan = mixing_plan(checkpoint(measured(docs)), weights)
    placed = _placed(measured(docs, *(f"`{c}`" for c in docs.columns)), *plan)
    taken = placed.withColumn("__mix_copies", _copies()).filter("__mix_copies > 0")
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(True), F.col("__mix_copies").cast("int"))).alias("__mix_copy")).drop("__mix_copy")
