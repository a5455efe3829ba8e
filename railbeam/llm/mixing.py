"""Mixing sources to target weights by entropy balancing (operator 2), with built-in functions alone.

Sizes are words. Every source has a token constraint: the words the mix takes from it equal its target. Among all
rates between 0 and ``max_copies`` that meet the constraints, those with the least relative entropy to "every
document once" are ``min(max_copies, exp(multiplier * size / mean size))``: exponentially tilted rates whose
multipliers solve a convex dual. Its gradient is one sum per source, so Newton steps for all sources are one
distributed aggregate each; a step that leaves the bracket of its source is replaced by a bisection.

Documents of one source and one size have the same rate, so the iterations run on the exact table of
(source, size, documents), not on documents. Rounding keeps cumulative copies of falling sizes next to their
cumulative rates; what is left to the target is closed by further copies of the sizes that fit it best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbeam.llm.common import renamed, stored, word_count

MAX_STEPS = 80
TOLERANCE = 1e-9
#: Rows of one source and size that are put in order within one task; more rows are spread over buckets.
BUCKET_ROWS = 200_000


def _placed(sources: DataFrame) -> DataFrame:
    """Sources with ``place``, their rank by code point with null last, without one task that holds them all."""
    order = F.asc_nulls_last("source")
    spread = stored(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return spread.withColumn("within", within).join(before, "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "before", "within")


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """(source, source_size, docs, place, target) of sources (source, source_size, docs).

    Weights repeat along the sources in order of code point, null last. A target stops at ``max_copies`` times
    the size of its source, and the excess goes to the others by weight until no target is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = stored(_placed(sources).withColumn("weight", weight), "mix-weights")
    cap = F.col("source_size") * max_copies
    level, closed = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = weighted.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap).otherwise(0)).alias("held"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open"),
            F.sum(full.cast("long")).alias("closed"),
        ).first()
        if not row["total"] or not row["open"] or row["closed"] == closed:
            break
        closed, level = row["closed"], (row["total"] - row["held"]) / row["open"]
    return weighted.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def multipliers(classes: DataFrame, sources: DataFrame, max_copies: int = 3) -> DataFrame:
    """(place, multiplier, mean) of the dual's solution; a null multiplier means that the rate is the limit.

    ``classes`` has (place, size, n), ``sources`` has (place, source_size, docs, target).
    """
    start = sources.where("target > 0").select(
        "place",
        "target",
        (F.col("source_size") / F.col("docs")).alias("mean"),
        F.lit(0.0).alias("multiplier"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        (F.col("target") >= F.col("source_size") * max_copies).alias("full"),
        F.lit(False).alias("done"),
    )
    now = stored(start, "mix-dual")
    x = F.col("size") / F.col("mean")
    power = F.exp(F.least(F.col("multiplier") * x, F.lit(50.0)))
    taken = F.col("n") * F.col("size") * F.least(power, F.lit(float(max_copies)))
    slope = F.when(power < max_copies, F.col("n") * F.col("size") * x * power).otherwise(0.0)
    for _ in range(MAX_STEPS):
        if now.where("not full and not done").isEmpty():
            break
        sums = classes.join(now, "place").groupBy("place").agg(F.sum(taken).alias("taken"), F.sum(slope).alias("slope"))
        off = F.col("taken") - F.col("target")
        tried = (
            now.join(sums, "place")
            .withColumn("low", F.when(off < 0, F.col("multiplier")).otherwise(F.col("low")))
            .withColumn("high", F.when(off > 0, F.col("multiplier")).otherwise(F.col("high")))
            .withColumn("done", F.abs(off) <= F.col("target") * TOLERANCE)
        )
        # Newton on the logarithm of the constraint, which is nearly straight.
        newton = F.col("multiplier") - F.ln(F.col("taken") / F.col("target")) * F.col("taken") / F.nullif(F.col("slope"), F.lit(0.0))
        reach = F.greatest(F.abs("multiplier"), F.lit(1.0)) * 4
        near = F.least(F.greatest(newton, F.col("multiplier") - reach), F.col("multiplier") + reach)
        middle = F.when(F.col("low").isNull(), F.col("high") - reach).when(F.col("high").isNull(), F.col("low") + reach).otherwise((F.col("low") + F.col("high")) / 2)
        inside = near.isNotNull() & ~F.isnan(near) & F.coalesce(near > F.col("low"), F.lit(True)) & F.coalesce(near < F.col("high"), F.lit(True))
        moved = F.when(F.col("done"), F.col("multiplier")).when(inside, near).otherwise(middle)
        stuck = F.coalesce(moved == F.col("multiplier"), F.lit(False))
        now = stored(tried.withColumn("done", F.col("done") | stuck).withColumn("multiplier", moved).select(now.columns), "mix-dual")
    return now.select("place", F.when(~F.col("full"), F.col("multiplier")).alias("multiplier"), "mean")


def _rounded(classes: DataFrame, sources: DataFrame, dual: DataFrame, max_copies: int) -> DataFrame:
    """(place, size, n, copies): whole copies of each class that bring every source next to its target."""
    limit = F.lit(float(max_copies))
    tilted = F.least(F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0))), limit)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("mean").isNull(), 0.0).when(F.col("multiplier").isNull(), limit).otherwise(tilted)
    falling = W.partitionBy("place").orderBy(F.desc("size"))
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(falling) + 0.5)
    first = classes.join(dual, "place", "left").withColumn("rate", rate).withColumn("upto", upto)
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(falling), F.lit(0))
    bounded = F.least(F.greatest(copies, F.lit(0)), F.col("n") * max_copies)
    now = stored(first.withColumn("copies", bounded).select("place", "size", "n", "copies"), "mix-copies")
    wanted = sources.select("place", "target")
    while True:
        rest = now.groupBy("place").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(wanted, "place").select("place", "target", (F.col("target") - F.col("taken")).alias("rest"))
        open_rest = rest.where(F.abs("rest") > F.greatest(F.lit(0.5), F.col("target") * 1e-4))
        room = F.when(F.col("rest") > 0, F.col("n") * max_copies - F.col("copies")).otherwise(F.col("copies"))
        fits = now.join(open_rest, "place").where((room > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("rest")))
        best = fits.groupBy("place").agg(F.min(F.struct(F.abs(F.abs("rest") - F.col("size")).alias("gap"), F.col("size").alias("size"))).alias("best"), F.first("rest").alias("rest"))
        chosen = stored(best.select("place", F.col("best.size").alias("size"), "rest"), "mix-rest")
        if chosen.isEmpty():
            return now
        times = F.least(room, F.greatest(F.lit(1), F.floor(F.abs("rest") / F.col("size"))))
        step = F.when(F.col("rest").isNull(), 0).otherwise(F.signum("rest").cast("long") * times)
        now = stored(now.join(chosen, ["place", "size"], "left").select("place", "size", "n", (F.col("copies") + step).alias("copies")), "mix-copies")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``; ``taken`` is copies times size.

    A null, empty or blank text has size 0 and one copy, which takes no words. A null source is a source of its
    own. Rows with a null doc_id and repeated rows each count as a document. An empty table gives an empty
    result; sources without words have the target 0. Reruns agree: nothing is drawn at random.
    """
    slim = renamed(docs, doc_id=doc_id, source=source, text=text).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    slim = stored(slim, "mix-sizes")
    counts = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    by_source = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = stored(targets(by_source, weights, max_copies), "mix-targets")
    keyed = counts.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source")))
    classes = stored(keyed.select("place", "size", "n"), "mix-classes")
    copies = _rounded(classes, sources, multipliers(classes, sources, max_copies), max_copies)
    named = copies.join(sources, "place").select(
        "place", F.col("source").alias("own"), F.col("size").alias("own_size"), "n", "copies", "source_size", "target"
    )
    rows = named.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + rows // BUCKET_ROWS
    mark = F.xxhash64("doc_id")
    met = slim.join(named, F.col("source").eqNullSafe(F.col("own")) & (F.col("size") == F.col("own_size"))).withColumn("bucket", F.pmod(mark, F.lit(buckets)))
    whole = met.groupBy("place", "size", "bucket").agg(F.count("*").alias("here"))
    before = whole.select("place", "size", "bucket", (F.sum("here").over(W.partitionBy("place", "size").orderBy("bucket")) - F.col("here")).alias("before"))
    rank = F.row_number().over(W.partitionBy("place", "size", "bucket").orderBy(mark, F.col("doc_id"))) - 1
    ranked = met.withColumn("within", rank).join(before, ["place", "size", "bucket"])
    extra = (F.col("before") + F.col("within") < F.col("copies") % F.col("n")).cast("long")
    each = F.floor(F.col("copies") / F.col("n")) + extra
    return ranked.select("doc_id", "size", "source_size", "target", (each * F.col("size")).alias("taken"), each.alias("copies"))


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; rows with copies 0 go, and rows with a null id stay once.

    Rows that share an id are each taken as often as the mix takes the most of them.
    """
    times = mixed.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").cast("int").alias("times"))
    rows = docs.select(F.col(doc_id).alias("id"), F.struct(*docs.columns).alias("row"))
    known = rows.join(times, "id").where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return known.select("row.*").unionByName(rows.where("id is null").select("row.*"))
