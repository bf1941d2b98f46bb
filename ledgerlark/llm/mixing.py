"""Mixing sources to target weights by entropy balancing.

Sources get targets in words: shares of all words by weight, none above ``CAP`` times the words it has; what exceeds is
shared again by weight. Within a source, document rates r stay as close to 1 as the target allows in relative entropy:
minimise sum(r ln r - r + 1) subject to sum(size r) = target and r <= CAP. The solution is exponentially tilted,
r = min(CAP, exp(lambda * size / mean size)), and Newton steps on the convex dual, all sources at once as one grouped
aggregation a step, find each lambda. Rates are then rounded into whole copies: each takes floor(r), and one more where
a hash of the row lies below the fraction plus a shift; the shift is chosen for each source so that its words come
within one document of its target. Where it would fall between rows of one hash, as rows equal in id and text have,
they are numbered and the first of them take the copy.

Null text has no words. A null source is a source of its own, last in order. Rows with equal ids are separate rows.
Which of rows equal in id and text take one more copy is not defined beyond their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, quoted

WEIGHTS, CAP, STEPS, BIN_BITS, ROUNDS = (5, 2, 1), 3, 40, 12, 3
KEY_BITS = 48


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from ``sizes(source, source_size)``, one row a source.

    Sources sorted by cap / weight fill up in that order: the first k are capped for the smallest k at which the rest,
    shared by weight, stays under every further cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    ranked = (
        weighed.withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("words", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("words") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def _dual(histogram: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """source, mean, lambda. ``histogram(source, size, n)``: documents of equal size have equal rates, so this is exact."""
    start = targets.join(histogram.groupBy("source").agg(F.sum("n").alias("docs")).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = start.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-800.0).alias("lo"), F.lit(800.0).alias("hi"), F.lit(False).alias("done"))
    for step in range(STEPS):
        state = scratch.save(state.coalesce(1), f"dual{step}")
        if step:
            scratch.drop(f"dual{step - 1}")
        if state.where("not done").isEmpty():
            break
        h = histogram.withColumnRenamed("source", "_s").join(state.where("not done"), F.col("source").eqNullSafe(F.col("_s"))).where("size > 0")
        x = F.col("size") / F.col("mean")
        free = F.col("lam") * x < F.log(F.lit(float(CAP)))
        rate = F.when(free, F.exp(F.least(F.col("lam") * x, F.lit(2.0)))).otherwise(F.lit(float(CAP)))
        moved = h.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("f"), F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("g"))
        j = state.join(moved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.coalesce(F.col("f"), F.lit(0.0)) - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        j = j.withColumn("gap", gap).withColumn("lo2", lo).withColumn("hi2", hi).withColumn("newton", F.col("lam") - F.col("gap") / F.when(F.col("g") > 0, F.col("g")))
        inside = (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        done = F.col("done") | F.col("f").isNull() | (F.abs("gap") <= F.greatest(F.lit(0.01), F.col("target") * 1e-6))
        state = j.select("source", "target", "mean", F.when(done, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done"))
    return state.select("source", "mean", "lam")


def mix_copies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row, size, source_size, target, rate, copies for every row of ``df(doc_id, text, source, …)``.

    ``row`` is a struct of ``columns`` (all by default), so columns of any name can pass through.
    """
    scratch = Scratch(df.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u = F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(1 << 48)) / float(1 << 48)
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in columns or df.columns]).alias("row"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), u.alias("_u"))
    slim = scratch.save(rows.select("source", "size", "_u"), "slim")
    histogram = scratch.save(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = scratch.save(source_targets(sizes).coalesce(1), "targets")
    plan = targets.join(_dual(histogram, targets, scratch).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s")
    plan = scratch.save(plan.coalesce(1), "plan")

    def rated(d: DataFrame) -> DataFrame:
        x = F.col("lam") * F.col("size") / F.col("mean")
        full = (F.col("target") >= CAP * F.col("source_size")) | (x >= F.log(F.lit(float(CAP))))
        out = d.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return out.withColumn("rate", F.when(full, F.lit(float(CAP))).otherwise(F.exp(F.least(x, F.lit(2.0)))))

    def keyed(d: DataFrame) -> DataFrame:
        """Adds key, the hash less the fraction as a whole number: rows below the shift take one more copy."""
        fraction = F.col("rate") - F.floor("rate")
        return rated(d).withColumn("key", F.floor((F.col("_u") - fraction + 1) * float(1 << KEY_BITS - 1)).cast("long"))

    spare = keyed(slim).where(f"rate < {CAP} and size > 0")  # rows at the cap take no more
    spare = scratch.save(spare.select("source", "key", "size"), "spare")
    base = rated(slim).groupBy("source").agg(F.sum(F.floor("rate").cast("long") * F.col("size")).alias("base"))
    state = targets.join(base.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("target") - F.coalesce("base", F.lit(0))).alias("need"), F.lit(0).cast("long").alias("cut"))
    for step in range(ROUNDS):
        width = 1 << KEY_BITS - BIN_BITS * (step + 1)
        state = scratch.save(state.coalesce(1), f"shift{step}")
        state = _narrowed(spare, state, width)
    shift = scratch.save(state.withColumnRenamed("source", "_s").coalesce(1), "shift")
    shared = scratch.save(_shares(spare, shift, width), "shared")
    full, cut = F.col("_m") == F.col("_n"), (F.col("_m") > 0) & (F.col("_m") < F.col("_n"))
    out = keyed(rows).join(shift.select("_s", "cut"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.join(shared.withColumnsRenamed({"source": "_s", "key": "_k", "size": "_z"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_z")), "left")
    may = (F.col("rate") < CAP) & (F.col("size") > 0)
    more = may & ((F.col("key") < F.col("cut")) | F.coalesce(full, F.lit(False)))
    parts = ["row", "size", "source_size", "target", "rate"]
    whole = F.floor("rate").cast("long")
    if shared.where(cut).isEmpty():
        return out.select(*parts, (whole + more.cast("long")).alias("copies"))
    tied = may & F.coalesce(cut, F.lit(False))
    ties = scratch.save(out.where(tied).select(*parts, "source", "key", "_m", F.monotonically_increasing_id().alias("_at")), "ties")
    return out.where(~tied).select(*parts, (whole + more.cast("long")).alias("copies")).unionAll(_numbered(ties).select(*parts, (whole + (F.col("_number") <= F.col("_m")).cast("long")).alias("copies")))


def _narrowed(spare: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """source, need, cut: the words still needed, and the bin of keys, ``width`` wide, in which the next row is too much.

    Where all rows fit, the cut lies beyond all keys.
    """
    inside = spare.withColumnRenamed("source", "_s").join(state, F.col("source").eqNullSafe(F.col("_s"))).where(f"key >= cut and key < cut + {width << BIN_BITS}L")
    bins = inside.groupBy("source", "need", F.expr(f"(key - cut) div {width}L").alias("bin")).agg(F.sum("size").alias("words"))
    below = bins.withColumn("sum", F.sum("words").over(W.partitionBy("source").orderBy("bin")))
    fits = F.col("sum") <= F.col("need")
    got = below.groupBy(F.col("source").alias("_s")).agg(F.max(F.when(fits, F.col("sum"))).alias("got"), F.min(F.when(~fits, F.col("bin"))).alias("next"))
    joined = state.join(got, F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select("source", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.coalesce(F.col("cut") + F.col("next") * width, F.lit(1 << KEY_BITS + 1)).alias("cut"))


def _shares(spare: DataFrame, shift: DataFrame, width: int) -> DataFrame:
    """source, key, size, _n, _m: of the _n rows with a key in the last bin, _m take one more copy, to the nearest row."""
    inside = spare.join(shift, F.col("source").eqNullSafe(F.col("_s"))).where(f"key >= cut and key < cut + {width}L")
    ties = inside.groupBy("source", "need", "key", "size").agg(F.count("*").alias("_n"))
    order = W.partitionBy("source").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("need") - F.coalesce(F.sum(F.col("_n") * F.col("size")).over(order), F.lit(0))
    m = F.greatest(F.lit(0), F.least("_n", F.floor(left / F.col("size") + 0.5)))
    return ties.select("source", "key", "size", "_n", m.cast("long").alias("_m"))


def _numbered(ties: DataFrame) -> DataFrame:
    """Adds _number, from 1, to the rows of a source and key: their place in their part after the rows of parts before.

    A window holds a part's rows, or a row a part, so a tie of a third of all rows isn't brought together.
    """
    parted = ties.withColumn("_part", F.shiftright("_at", 33))
    counts = parted.groupBy("source", "key", "_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("source", "key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("_part").alias("_p"), before.alias("_before"))
    own = F.row_number().over(W.partitionBy("source", "key", "_part").orderBy("_at"))
    numbered = parted.withColumn("_own", own)
    joined = numbered.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_number", F.col("_before") + F.col("_own"))


def mix_expand(df: DataFrame) -> DataFrame:
    """The rows of the mix: every row of ``df`` as often as its copies, in the columns of ``df``."""
    taken = mix_copies(df).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
