"""Mixing sources to target weights along a curriculum.

Targets: the sources share a budget of words by weight; none takes more than
``most`` times its own size, and what that leaves over is shared again. The
level at which this settles is found by sorting sources by size per weight.

Curriculum: every source has a weight schedule over training time 0..1, linear
between its ends. Its integral, scaled to the target, is the cumulative demand.
The words of a source, in a hashed order and repeated as often as needed, fill
that demand; a document's position is the time at which the demand reaches the
middle of its words, the inverse of the integral.

Running sums are taken in two levels: inside buckets of bounded size, and over
the buckets, so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import WORD_PATTERN
from kindred.session import materialise


@dataclass(frozen=True)
class Mix:
    """``slopes``: by how much a source's weight rises (or falls) over time, given round robin like ``weights``."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    slopes: tuple[float, ...] = (-0.5, 0.5, 0.8)
    share: float = 1.5
    most: float = 2.0
    bucket_rows: int = 2_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")


def running_sums(df: DataFrame, order: str, value: str, rows: int) -> DataFrame:
    """Add ``before``, the sum of ``value`` over rows with a smaller ``order``, and ``place``, their number.

    ``order`` must have no ties and no nulls. Works on ranges of about ``rows``
    rows: a sum inside each range, and one over the ranges.
    """
    n = df.count()
    ranges = max(1, -(-n // rows))
    cut = materialise(
        df.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    totals = cut.groupBy("range").agg(F.sum(value).alias("part"), F.count("*").alias("rows"))
    over = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "range", F.coalesce(F.sum("part").over(over), F.lit(0)).alias("part"), F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows")
    )
    inside = W.partitionBy("range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return cut.join(starts, "range").select(
        *df.columns,
        (F.col("part") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("before"),
        (F.col("rows") + F.row_number().over(W.partitionBy("range").orderBy(order)) - 1).alias("place"),
    )


def cycle(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source_key, source_size, target, slope`` per source. Sources with no words get 0."""
    per_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = running_sums(per_source, "source_key", "source_size", 100_000)
    ranked = ranked.select(
        "source_key", "source_size", "n_docs",
        cycle(mix.weights, F.col("place")).alias("weight"), cycle(mix.slopes, F.col("place")).alias("slope"),
    )
    ranked = materialise(ranked.withColumn("ratio", F.col("source_size") / F.col("weight")), "sources")
    # sources fill up in the order of size per weight: at equal ratios they fill up together
    levels = ranked.groupBy("ratio").agg(F.sum("source_size").alias("filled"), F.sum("weight").alias("weight"))
    total = levels.agg(F.sum("filled").alias("all"), F.sum("weight").alias("weights"))
    before = running_sums(levels.select("ratio", "filled"), "ratio", "filled", 100_000).select("ratio", F.col("before").alias("full_before"))
    weight = running_sums(levels.select("ratio", "weight"), "ratio", "weight", 100_000).select("ratio", F.col("before").alias("weight_before"))
    # the level at which the sources up to this one are full and the rest share what is left
    level = (
        before.join(weight, "ratio").crossJoin(F.broadcast(total))
        .withColumn("level", (F.col("all") * mix.share - F.col("full_before") * mix.most) / (F.col("weights") - F.col("weight_before")))
        .where(F.col("level") <= F.col("ratio") * mix.most)
        .agg(F.min_by("level", "ratio").alias("level"))
    )
    # no level: the budget exceeds what all sources may give
    target = F.least(F.col("source_size") * mix.most, F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * mix.most))
    return ranked.crossJoin(F.broadcast(level)).select("source_key", "source_size", "n_docs", target.cast("double").alias("target"), "slope")


def demand_time(share: Column, slope: Column) -> Column:
    """The time at which a source has given ``share`` of its target.

    Its weight is ``1 + slope * (2 t - 1)``, whose integral ``(1 - slope) t + slope t^2``
    is inverted in a form that holds at slope 0 as well.
    """
    a = F.lit(1.0) - slope
    return F.lit(2.0) * share / (a + F.sqrt(F.greatest(a * a + F.lit(4.0) * slope * share, F.lit(0.0))))


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, position`` per document.

    ``taken`` counts words, repeats included: a source gives its documents in a
    hashed order, ``target / source_size`` times over, and stops inside a document
    if need be, so the words taken are the target rounded down. ``position`` is
    the time of the first taken word's document (null if nothing is taken).
    Null texts and texts without words have size 0. Null is a source of its own,
    the last. Rows that repeat a ``doc_id`` are each a document, told apart by a
    hash of their text; rows equal in both share what they take in equal order. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        size_of(F.col("text")).alias("size"),
        "source",
        # code points in order, null after every string
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
        F.xxhash64("doc_id", "text").alias("tie"),
    )
    rows = materialise(rows, "sizes")
    sources = materialise(source_targets(rows, mix), "targets")
    buckets = F.ceil(F.col("n_docs") / mix.bucket_rows)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "tie"), 1)
    spread = (
        rows.join(sources, "source_key")
        .withColumn("drawn", drawn)
        .withColumn("bucket", (F.col("drawn") / F.lit(float(1 << 63)) * buckets).cast("long"))
    )
    sums = spread.groupBy("source_key", "bucket").agg(F.sum("size").alias("part"))
    over = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source_key", "bucket", F.coalesce(F.sum("part").over(over), F.lit(0)).alias("start"))
    inside = W.partitionBy("source_key", "bucket").orderBy("drawn", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        spread.join(starts, ["source_key", "bucket"])
        .withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    budget = F.floor("target")
    passes = [
        F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before") - F.col("source_size") * i))
        for i in range(-int(-mix.most // 1))
    ]
    times = [
        F.when(p > 0, demand_time((F.col("before") + F.col("source_size") * i + p / 2.0) / F.col("target"), F.col("slope")))
        for i, p in enumerate(passes)
    ]
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", "tie",
        sum(passes, F.lit(0)).cast("long").alias("taken"),
        F.array(*[p.cast("long") for p in passes]).alias("words"),
        F.array(*times).alias("times"),
        times[0].alias("position"),
    )


def in_training_order(planned: DataFrame) -> DataFrame:
    """Rows of ``plan`` sorted into ranges by position; what is not taken comes last, ties by id."""
    position = F.col("position").asc_nulls_last()
    return planned.repartitionByRange(position, "doc_id").sortWithinPartitions(position, "doc_id")


def _copies(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each of the rows that agree in id, text and source.

    Equal rows are counted where they are before anything is shuffled. Of rows
    that differ in other columns, those columns set the order.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    counted = docs.groupBy(*names).agg(F.count("*").alias("__n"))
    order = [F.col(f"`{f.name}`") for f in docs.drop("text").schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    before = W.partitionBy("doc_id", F.xxhash64("doc_id", "text"), "source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1
    return counted.withColumn("__first", first).select(*names, F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)).alias("__copy"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as the mix takes them: a row for every pass, sorted into ranges by position.

    The one document at which a source's demand ends is cut after the words
    taken. ``n_chars``, if there is one, follows the text. All columns of ``docs``
    stay and none is added. Rows that agree in id, text and source each take
    passes of their own. An empty table gives none; nulls as in ``plan``.
    """
    keys = ["doc_id", "tie", "source"]
    chosen = materialise(plan(docs, mix).where("taken > 0").select(*keys, "words", "times", "size"), "taken")
    rows = docs.withColumn("__copy", F.lit(1).cast("long"))
    chosen_copy = F.lit(1).cast("long")
    if not chosen.groupBy(*keys).count().where("count > 1").isEmpty():
        rows, chosen_copy = _copies(docs), F.row_number().over(W.partitionBy(*keys).orderBy(F.col("times")[0])).cast("long")
    chosen = chosen.withColumn("copy", chosen_copy)
    chosen = chosen.select(*keys, "copy", F.explode(F.arrays_zip("words", "times")).alias("__pass"), F.col("size").alias("__size"))
    chosen = chosen.where("__pass.words > 0")
    here = [F.col(f"d.{x}").eqNullSafe(F.col(f"c.{y}")) for x, y in (("doc_id", "doc_id"), ("__tie", "tie"), ("source", "source"), ("__copy", "copy"))]
    joined = rows.withColumn("__tie", F.xxhash64("doc_id", "text")).alias("d").join(chosen.alias("c"), here)
    words = F.regexp_extract_all(F.col("d.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0))
    cut = F.when(F.col("__pass.words") >= F.col("__size"), F.col("d.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("__pass.words").cast("int")), ""))
    out = joined.select("d.*", cut.alias("__text"), "__pass").withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("__text").cast(docs.schema["n_chars"].dataType))
    time = F.col("__pass.times")
    return out.repartitionByRange(time, F.col("doc_id")).sortWithinPartitions(time, "doc_id").select(*docs.columns)
