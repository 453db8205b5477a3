"""Mixing sources to target weights by weighted fair queueing (operator 3).

Documents of a source queue in the order of a hash. A document's virtual finish
time is its source's cumulative words over the source's target; a second and a
third pass over the queue go on from there. The mix is the documents in order
of finish time up to virtual time 1, where every source has had its target: the
document in service then is cut, and the whole is truncated at the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import running_total, stage

#: The weights that sources take in turn, and passes over a source at most.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Words of a text.
WORD = r"[^ \t\n\x0B\f\r]+"
#: Rows of one source that are sorted in one task, about.
ROWS_PER_PIECE = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """Targets of ``sizes (source, source_size)``: one row a source, null last.

    All sizes are shared by weight; a target stops at ``passes`` times its
    source's size and the excess goes to the others by weight. Filled from the
    source with the least cap per weight on, this is one ordered pass.
    """
    one = F.lit(0)
    ranked = sizes.withColumn("__k", F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__k") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(passes))
    order = Window.partitionBy(one).orderBy(F.col("__cap") / F.col("__w"), "__k")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy(one)) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(onward)
    filled = caps.withColumn("__level", level).withColumn("__full", F.col("__cap") <= F.col("__level") * F.col("__w"))
    # the first source that is not full sets the level of all that follow
    rest = F.min(F.when(~F.col("__full"), F.struct("__rank", "__level"))).over(Window.partitionBy(one))
    return (
        filled.withColumn("__rank", F.row_number().over(order)).withColumn("__rest", rest)
        .withColumn("target", F.when(F.col("__rest").isNull() | (F.col("__rank") < F.col("__rest.__rank")), F.col("__cap").cast("double")).otherwise(F.col("__rest.__level") * F.col("__w")))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, passes: int = MAX_PASSES, rows_per_piece: int = ROWS_PER_PIECE, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, the columns named in ``keep``, ``size``, ``source_size``,
    ``target`` of its source and ``taken``, the words that the mix takes of it,
    repeats counted.

    Null texts have size 0; null sources are one source and null ids queue
    first; rows alike in id and text share a place in the queue's order, one
    after the other. Every row gives one row. Reruns give the same rows.
    """
    extra = [c for c in keep if c not in (id_col, source_col)]
    # the id's digest shuffles the queue; the text's hash parts rows of one id
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__turn"), F.xxhash64(F.col(text_col)).alias("__own"),
        *[F.col(c).alias(f"__keep_{c}") for c in extra],
    )
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "mixture")
    by_source = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumnRenamed("__source", "source")
    by_source = stage(by_source, "mixture-sources")
    most = by_source.agg(F.max("n").alias("n")).first()["n"] or 0
    pieces = max(1, -(-most // rows_per_piece))
    target = source_targets(by_source.select("source", "source_size"), weights, passes)
    # the queue's order is that of a 128-bit digest; its first 32 bits cut it into pieces
    piece = F.floor(F.conv(F.substring("__turn", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * pieces).cast("int")
    queued = running_total(rows.withColumn("__piece", piece), ["__source"], "__piece", [F.col("__turn"), F.col("__own"), F.col("__size")], "__size", "__cum")
    joined = queued.join(F.broadcast(target) if by_source.count() <= 10_000 else target, F.col("__source").eqNullSafe(F.col("source")))
    start = F.col("__cum") - F.col("__size") + F.col("__pass") * F.col("source_size")
    packets = joined.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("__start", start)
    # what of the document is served up to virtual time 1: all, or the part before its source's target
    served = F.least(F.greatest(F.floor("target") - F.col("__start"), F.lit(0)), F.col("__size"))
    finish = (F.col("__start") + F.col("__size")) / F.when(F.col("target") > 0, F.col("target"))
    packets = packets.withColumn("__served", served).where("__pass = 0 or __served > 0").withColumn("__finish", F.coalesce(F.least(finish, F.lit(2.0)), F.lit(2.0)))
    # in order of finish time, truncated at the budget of all words
    total = by_source.agg(F.sum("source_size").alias("w"), F.sum("n").alias("n")).first()
    ranges = max(1, -(-(total["n"] or 0) * passes // rows_per_piece))
    # what isn't served adds nothing to the sums: it is spread beyond the last range
    place = F.when(F.col("__served") > 0, F.floor(F.col("__finish") * ranges)).otherwise(2 * ranges + 1 + F.pmod(F.col("__row"), F.lit(ranges)))
    ordered = running_total(
        packets.withColumn("__range", place.cast("int")), [], "__range",
        [F.col("__finish"), F.col("__turn"), F.col("__own"), F.col("__row"), F.col("__pass")], "__served", "__sum",
    )
    left = F.lit(total["w"] or 0) - (F.col("__sum") - F.col("__served"))
    took = ordered.withColumn("__took", F.least(F.greatest(left, F.lit(0)), F.col("__served")))
    kept = [F.first(f"__keep_{c}").alias(c) for c in extra]
    return took.groupBy("__row").agg(
        F.first("__id").alias(id_col), *([F.first("__source").alias(source_col)] if source_col in keep else []), *kept,
        F.first("__size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("__took").cast("bigint").alias("taken"), F.min("__finish").alias("finish"),
    ).drop("__row")
