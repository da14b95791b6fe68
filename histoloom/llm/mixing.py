"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1. Of all rates whose tokens sum to each source's
target, and that repeat no document more than ``most`` times, the ones nearest
to the start in relative entropy are exponential tilts, rate = min(most,
exp(lambda * size)), with one multiplier a source: the solution of the convex
dual. Newton's iteration on it needs two sums a source, which each iteration
takes from a pre-aggregated table of (source, size); a bracket guards each step,
and several steps are one job.

Rates are rounded to copies by a hash of doc_id and text, and what a source is then off
its target is made up by flipping copies of a few documents, largest first.

DataFrame operations only. Nothing is sent to the driver but one number an
iteration, and joins on sources are left to Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm import shared

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size -> those with sid and target.

    Each source's share of ``share`` times all sizes is by weight; a target
    stops at ``most`` times the source's size and the excess goes to the others
    by weight, until none is above. With the sources ordered by the level at
    which each stops, the level of the rest is (what is to be shared - what the
    stopped ones take) / (weights of the rest): the first source whose own level
    is not below it is the first that does not stop. One row a source is sorted.
    """
    ranked = totals.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long").alias("sid"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    known = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to_share = F.lit(float(share)) * F.sum("source_size").over(everything)
    stopped = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = known.withColumn("level", (to_share - stopped) / rest)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return leveled.withColumn("level", level).select("source", "source_size", "sid", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(tilt: Column, size: Column, longest: Column, most: float) -> Column:
    # The exponent is cut where the rate is most anyway.
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size / longest, F.lit(20.0))))


def tilts(cells: DataFrame, sources: DataFrame, most: float, tolerance: float = 1e-7, max_rounds: int = 80, steps: int = 4) -> DataFrame:
    """sid, tilt, longest for each source. ``cells``: sid, size, n; size > 0.

    ``steps`` iterations are one job; the state, a row a source, is written
    after each job and the iteration ends when all sources have settled.
    """
    longest = cells.groupBy("sid").agg(F.max("size").cast("double").alias("longest"))
    top = F.log(F.lit(float(most))) * F.col("longest")
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    state = shared.written(
        sources.join(longest, "sid").select("sid", "target", "longest", F.when(full, top).otherwise(0.0).alias("tilt"), (F.col("longest") * -60.0).alias("low"), top.alias("high"), full.alias("done")), "tilt"
    )

    def moved(state: DataFrame) -> DataFrame:
        """One safeguarded Newton step; a source's own columns come along as keys."""
        rate = _rate(F.col("tilt"), F.col("size"), F.col("longest"), most)
        taken = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, taken * F.col("size") / F.col("longest")).otherwise(0.0)
        sums = cells.join(state, "sid").groupBy(*state.columns).agg(F.sum(taken).alias("f"), F.sum(slope).alias("g"))
        off = F.abs(F.col("f") - F.col("target")) <= F.lit(tolerance) * F.col("target")
        low = F.when(F.col("f") <= F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("f") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        # Newton's step on the logarithm of the sum, or the middle of the bracket.
        step = F.col("tilt") - F.log(F.col("f") / F.col("target")) * F.try_divide("f", "g")
        inside = step.isNotNull() & (step > low) & (step < high)
        settled = F.col("done") | off | (high - low <= F.lit(1e-12) * F.col("longest"))
        return sums.select("sid", "target", "longest", F.when(settled, F.col("tilt")).when(inside, step).otherwise((low + high) / 2).alias("tilt"), low.alias("low"), high.alias("high"), settled.alias("done"))

    for _ in range(0, max_rounds, steps):
        after = state
        for _ in range(steps):
            after = moved(after)
        before, state = state, shared.written(after, "tilt", small=True)
        shared.drop(before)
        if state.agg(F.bool_and("done")).first()[0] in (True, None):
            break
    # So many digits that sums added in another order give the same rates.
    return state.select("sid", "longest", F.round("tilt", 8).alias("tilt"))


def _mark(doc_id: Column, text: Column) -> Column:
    """What a row's rounding goes by: rows of one doc_id and other texts differ."""
    return F.xxhash64(doc_id.cast("long"), text)


def _unit(mark: Column, salt: int) -> Column:
    """A number in [0, 1), a multiple of 2^-53."""
    return F.shiftrightunsigned(F.xxhash64(mark, F.lit(salt)), 11) / F.lit(float(1 << 53))


def _copies(mark: Column, rate: Column) -> Column:
    return (F.floor(rate) + F.when(_unit(mark, 1) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def flips(rows: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Which copies to add or take away: sid, size, copies, sign, until.

    ``rows``: mark, sid, size > 0, copies. A document of a listed (sid, size,
    copies) changes by ``sign`` copies if its second hash is not above
    ``until``. A round takes, for each source, cells by falling size as long as
    they fit what the source is off, and as much as fits of the first that does
    not. What is then left is below that size and at most half of what it was,
    so rounds are few; they end when nothing fits any more.
    """
    cell = ["sid", "size", "copies"]
    cells = shared.written(rows.groupBy(*cell).agg(F.count("*").alias("n")), "cells", small=True)
    taken = cells.groupBy("sid").agg(F.sum(F.col("size") * F.col("copies") * F.col("n")).alias("taken"))
    gaps = sources.join(taken, "sid").select("sid", F.round(F.col("target") - F.col("taken")).cast("long").alias("gap"), F.lit(None).cast("struct<size:long,copies:long>").alias("last"))
    picks: list[DataFrame] = []
    while True:
        can = F.when(F.col("gap") > 0, F.col("copies") + 1 <= F.lit(int(most))).otherwise(F.col("copies") > 0)
        new = F.col("last").isNull() | (F.struct("size", "copies") < F.col("last"))
        fits = cells.join(gaps.where("gap <> 0"), "sid").where(can & new & (F.col("size") <= F.abs("gap")))
        # A source has as many cells as sizes, whatever the corpus.
        order = Window.partitionBy("sid").orderBy(F.desc("size"), F.desc("copies"))
        before = F.sum(F.col("n") * F.col("size")).over(order) - F.col("n") * F.col("size")
        k = F.least(F.col("n"), F.floor((F.abs("gap") - before) / F.col("size")).cast("long"))
        picked = shared.written(fits.withColumn("k", k).where("k > 0").select(*cell, F.signum("gap").cast("long").alias("sign"), "k", "n", "gap"), "picks", small=True)
        if picked.isEmpty():
            shared.drop(picked)
            break
        picks.append(picked)
        gaps = picked.groupBy("sid").agg((F.first("gap") - F.sum(F.col("sign") * F.col("k") * F.col("size"))).alias("gap"), F.min(F.struct("size", "copies")).alias("last"))
    chosen = picks[0] if picks else cells.limit(0).select(*cell, F.lit(0).cast("long").alias("sign"), F.lit(0).cast("long").alias("k"), "n", F.lit(0).cast("long").alias("gap"))
    for x in picks[1:]:
        chosen = chosen.union(x)
    # Of a cell that is not taken whole, the k smallest hashes: counts of 2^16
    # ranges find the one that holds the kth, and only its rows are ordered.
    part = chosen.where("k < n").select(*cell, "sign", "k")
    inside = rows.join(part, cell).select(*cell, "sign", "k", _unit(F.col("mark"), 2).alias("unit")).withColumn("range", F.floor(F.col("unit") * 65536))
    counts = inside.groupBy(*cell, "sign", "k", "range").agg(F.count("*").alias("m"))
    upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*cell).orderBy("range")))
    edge = upto.where((F.col("upto") - F.col("m") < F.col("k")) & (F.col("k") <= F.col("upto"))).select(*cell, "range", (F.col("upto") - F.col("m")).alias("below"))
    # Rows of one hash are taken together or not at all.
    among = F.col("below") + F.count("*").over(Window.partitionBy(*cell).orderBy("unit").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = inside.join(edge, [*cell, "range"]).withColumn("i", among)
    last = F.coalesce(F.max(F.when(F.col("i") <= F.col("k"), F.col("unit"))), F.first("range") / 65536 - F.lit(2.0**-53))
    some = ranked.groupBy(*cell, "sign").agg(last.alias("until"))
    out = shared.written(some.union(chosen.where("k = n").select(*cell, "sign", F.lit(1.0).alias("until"))), "flips", small=True)
    for x in [cells, *picks]:
        shared.drop(x)
    return out


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with size, source_size, target, taken and copies.

    A null text has size 0; null sources are one source, the last; documents of
    size 0 are taken once and count nothing; rows of one doc_id and text are
    taken alike, others each by themselves; an empty table gives no rows. Columns of ``docs`` with these names
    are replaced. Each source's taken words come as near its target as its
    smallest documents let them; no document is taken more than ``most`` times.
    """
    sized = docs.withColumn("size", words(F.col("text")))
    narrow = shared.written(sized.select(_mark(F.col("doc_id"), F.col("text")).alias("mark"), "source", "size"), "sizes")
    counts = shared.written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "counts", small=True)
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = shared.written(targets(totals, share, most, weights), "sources")
    ids = sources.select(F.col("source").alias("its_source"), "sid")
    of = F.col("source").eqNullSafe(F.col("its_source"))
    cells = counts.where("size > 0").join(ids, of).select("sid", "size", "n")
    solved = tilts(cells, sources, most)
    known = shared.written(sources.join(solved, "sid", "left").select(F.col("source").alias("its_source"), "sid", "source_size", "target", "tilt", "longest"), "known")

    for x in (counts, solved):
        shared.drop(x)

    def with_copies(rows: DataFrame, mark: Column) -> DataFrame:
        rate = F.coalesce(_rate(F.col("tilt"), F.col("size"), F.col("longest"), most), F.lit(1.0))
        out = rows.join(known, of).drop("its_source")
        return out.withColumn("copies", F.when(F.col("size") > 0, _copies(mark, rate)).otherwise(1))

    turned = flips(with_copies(narrow, F.col("mark")).where("size > 0").select("mark", "sid", "size", "copies"), known, most)
    for x in (narrow, sources):
        shared.drop(x)
    turned = turned.selectExpr("sid f_sid", "size f_size", "copies f_copies", "sign f_sign", "until f_until")
    own = _mark(F.col("doc_id"), F.col("text"))
    rows = with_copies(sized.drop("sid", "source_size", "target", "tilt", "longest", "copies", "taken", "its_source"), own)
    joined = rows.join(turned, (F.col("sid") == F.col("f_sid")) & (F.col("size") == F.col("f_size")) & (F.col("copies") == F.col("f_copies")), "left")
    change = F.when(_unit(own, 2) <= F.col("f_until"), F.col("f_sign")).otherwise(0)
    out = joined.withColumn("copies", F.col("copies") + change).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("sid", "tilt", "longest", "f_sid", "f_size", "f_copies", "f_sign", "f_until")


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs``, each row as often as the mix takes it, with its own columns.

    Nulls, empty texts and repeated rows are handled as in :func:`mix`; rows that
    are not taken are left out; an empty table gives no rows.
    """
    kept = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    taken = mix(kept, **options)
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
