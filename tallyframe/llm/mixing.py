"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, without

RESULT = ("size", "source_size", "target", "copies", "taken")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3):
    """Targets per source: ``totals`` has one row per source with ``source`` and ``source_size``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A target stops at ``most`` times its source's size, and what is above is shared again
    by weight. Filled in order of cap over weight, the sources that stop are the first ones, so
    one pass of running sums finds them. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.row_number().over(order) - 1) % len(weights) + 1,
    ).cast("long")
    table = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    table = table.select(
        "source",
        "source_size",
        "weight",
        "cap",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)).alias(
            "left_size"
        ),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).alias(
            "left_weight"
        ),
    )
    # whole numbers, so that no rounding decides
    table = table.withColumn(
        "stops", F.col("cap") * F.col("left_weight") <= F.col("left_size") * F.col("weight")
    )
    size = F.sum("source_size").over(everything) - F.sum(
        F.when(F.col("stops"), F.col("cap")).otherwise(zero)
    ).over(everything)
    share = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    return table.select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("cap").cast("double"))
        .otherwise(size.cast("double") * F.col("weight") / share)
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """How often each document enters the mix.

    Adds ``size`` (words), ``source_size`` and ``target`` (words of the source, and wanted of
    it), ``copies`` and ``taken`` (words the mix takes, repeats counted). Every document of a
    source expects the same number of copies, target over source size. In the source's order
    the expected copies add up to ``expected * position``; after one random offset in [0, 1) a
    document is emitted once per whole number that the sum crosses. The order goes by size, so
    the words taken come near the target. Offsets come from a digest of the source and ``seed``:
    reruns agree.

    The position of a document is found without a window over its source: chunks of a source
    (size on a scale of eighths of a power of two, by 64 spreads of the id) are counted first,
    the counts are added up over the few thousand chunks of a source, and rows are numbered
    inside their chunk. A source with a third of all rows, or copies of one text, spread likewise.

    Null text: size 0, and the expected copies of its source as any other document. Null source:
    a source of its own, last in order. A source without words: target 0, no copies. Null ids and
    repeated rows are documents of their own; equal rows are interchangeable. Empty table: none.
    Input columns called like a result column are replaced.
    """
    docs = without(docs, *RESULT)
    source = F.col(f"`{source_col}`")
    bits = F.bin("size")
    digest = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    spread = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 64
    sized = (
        docs.withColumn(
            "size", F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0))
        )
        .withColumn("size", F.col("size").cast("long"))
        .withColumn("__tie", F.xxhash64(F.col(f"`{text_col}`")))
        .withColumn(
            "__chunk",
            (F.length(bits) * 8 + F.conv(F.substring(F.rpad(bits, 4, "0"), 2, 3), 2, 10).cast("int"))
            * 64
            + spread,
        )
    )
    # a struct equals another also where both hold a null
    sized = sized.withColumn("__source", F.struct(source.alias("source")))
    chunks = sized.groupBy("__source", "__chunk").agg(
        F.count("*").alias("rows"), F.sum("size").alias("words")
    ).withColumn("source", F.col("__source.source"))
    totals = chunks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, most)
    earlier = (
        Window.partitionBy("source")
        .orderBy("__chunk")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = chunks.withColumn("__first", F.sum("rows").over(earlier) - F.col("rows")).alias("c")
    placed = placed.join(
        targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))
    ).select("c.__source", "c.__chunk", "__first", "source_size", "target")
    # window and join go by the same columns, so the texts are shuffled once
    inside = Window.partitionBy("__source", "__chunk").orderBy(
        "size", F.col(f"`{id_col}`"), "__tie"
    )
    ranked = sized.withColumn("__rank", F.row_number().over(inside) - 1)
    joined = ranked.join(placed, ["__source", "__chunk"])
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit(""))).cast("binary"))
    offset = F.conv(F.substring(draw, 1, 6), 16, 10).cast("double") / float(1 << 24)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    position = (F.col("__first") + F.col("__rank")).cast("double")
    crossed = F.floor(offset + share * (position + 1.0)) - F.floor(offset + share * position)
    return (
        joined.withColumn("copies", F.least(crossed, F.ceil(share)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__tie", "__chunk", "__rank", "__source", "__first")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was drawn."""
    kept = mixed.filter(F.col("copies") > 0)
    return kept.select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")
    ).drop("__copy", *RESULT)
