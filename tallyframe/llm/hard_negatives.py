"""Hard negatives by slot-decomposed selection.

The scores of an anchor's positives cut the scores of its candidates into disjoint slots, one up to
each positive's score. Every block of candidates keeps the best k of each slot; blocks are merged
by the same rule. The answer for a positive is the best k of its own slot and all lower ones, so
one merge from the lowest slot upwards answers the overlapping windows of all positives.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

LEAST, LONGEST = -(1 << 63), (1 << 63) - 1
CELLS = 1 << 21  # scores looked at together
FOUND = "anchor string, slot int, score long, id long"


def integer_rows(
    df: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int
) -> DataFrame:
    """Rows that take part: ``id``, ``label`` as text, ``anchor``, ``x = floor(scale * entry)``."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        vector.alias("vector"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & ~bad)
    sizes = whole.groupBy(F.size("vector").alias("d")).count()
    top = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = int(top.d) if top else 0
    # so that no inner product leaves the range of a long
    most = float(isqrt(LONGEST // max(d, 1)) >> 1)
    scaled = F.transform(
        "vector",
        lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(most)), F.lit(-most))),
    )
    kept = whole.filter((F.size("vector") == d) & (F.size("vector") > 0))
    return kept.select("id", "label", "anchor", scaled.alias("x")).distinct()


def _best(anchor, slot, score, ident, k: int) -> np.ndarray:
    """Places of the best ``k`` of each anchor and slot, ties to the smaller id."""
    order = np.lexsort((ident, -score, slot, anchor))
    group = anchor[order] * (slot.max(initial=0) + 1) + slot[order]
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return order[rank < k]


def _select(same_label: bool, k: int):
    """Per block of anchors and candidates: the best ``k`` candidates of every anchor and slot."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table(
            {
                "anchor": pa.array([], pa.string()),
                "slot": pa.array([], pa.int32()),
                "score": pa.array([], pa.int64()),
                "id": pa.array([], pa.int64()),
            }
        )
        if not left.num_rows or not right.num_rows:
            return empty
        xs = [
            t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            for t in (left, right)
        ]
        reach = [int(np.abs(x).max()) for x in xs]
        if reach[0] * reach[1] * xs[0].shape[1] < 1 << 53:  # exact in doubles
            xs = [x.astype(np.float64) for x in xs]
        labels, _ = pd.factorize(
            np.array(left.column("label").to_pylist() + right.column("label").to_pylist(), object)
        )
        own, other = labels[: left.num_rows], labels[left.num_rows :]
        a_ids, r_ids = (t.column("id").to_numpy() for t in (left, right))
        given = [left.column(c).to_pylist() for c in ("upper", "lower")]
        slots = max(len(u) for u in given[0])
        upper = np.full((left.num_rows, slots), LEAST, np.int64)
        lower = np.full((left.num_rows, slots), LONGEST, np.int64)
        for row, (up, low) in enumerate(zip(*given)):
            upper[row, : len(up)], lower[row, : len(low)] = up, low
        top, bottom = upper[:, 0], lower.min(axis=1)
        floor = np.where(lower == LONGEST, LONGEST, LEAST)  # the k-th best so far
        kept = [np.zeros(0, np.int64)] * 4
        width = max(CELLS // max(len(a_ids), 1), 1)
        for start in range(0, len(r_ids), width):
            cols = slice(start, start + width)
            scores = (xs[0] @ xs[1][cols].T).astype(np.int64)
            if same_label:
                ok = (own[:, None] == other[cols][None]) & (a_ids[:, None] != r_ids[cols][None])
            else:
                ok = own[:, None] != other[cols][None]
            ok &= (scores <= top[:, None]) & (scores >= np.maximum(bottom, floor.min(axis=1))[:, None])
            rows, at = np.nonzero(ok)
            value = scores[rows, at]
            slot = (upper[rows] >= value[:, None]).sum(axis=1) - 1
            keep = (value >= lower[rows, slot]) & (value >= floor[rows, slot])
            new = [rows[keep], slot[keep], value[keep], r_ids[cols][at[keep]]]
            kept = [np.concatenate(pair) for pair in zip(kept, new)]
            best = _best(*kept, k)
            kept = [v[best] for v in kept]
            group = kept[0] * slots + kept[1]
            last = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) if len(group) else []
            count = np.bincount(group, minlength=floor.size)
            for p in last:
                if count[group[p]] >= k:
                    floor.flat[group[p]] = kept[2][p]
        keys = left.column("anchor").to_pylist()
        return pa.table(
            {
                "anchor": pa.array([keys[r] for r in kept[0]], pa.string()),
                "slot": pa.array(kept[1].astype(np.int32)),
                "score": pa.array(kept[2]),
                "id": pa.array(kept[3]),
            }
        )

    return run


def _numbers(count: int) -> Column:
    """All whole numbers from 0 up to ``count``, exclusive."""
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def _ranked(anchors: DataFrame, rows: DataFrame, sizes, same_label: bool, k: int) -> DataFrame:
    """The best ``k`` rows of each anchor and slot, over all blocks.

    Anchors and rows form blocks of bounded size; each block of anchors meets each block of rows
    once. Every row is sent once per block of anchors and every anchor once per block of rows.
    """
    anchor_blocks, row_blocks = sizes
    left = anchors.select(
        "*",
        F.pmod(F.xxhash64("anchor"), F.lit(anchor_blocks)).alias("ab"),
        F.explode(_numbers(row_blocks)).alias("rb"),
    )
    right = rows.select(
        # columns of their own, as both sides come from one table
        *[F.col(c).alias(c) for c in ("id", "label", "x")],
        F.explode(_numbers(anchor_blocks)).alias("ab"),
        F.pmod(F.xxhash64("id", "label", "x"), F.lit(row_blocks)).alias("rb"),
    )
    found = (
        left.groupBy("ab", "rb")
        .cogroup(right.groupBy("ab", "rb"))
        .applyInArrow(_select(same_label, k), FOUND)
    )
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    lowest: int = 80,
    highest: int = 100,
    scale: int = 256,
    block_rows: int = 50_000,
) -> DataFrame:
    """Hard negatives of every anchor's nearest positives.

    ``anchor`` marks the rows that are anchors. A score is the inner product of vectors whose
    entries became floor(scale * entry); higher is first, ties go to the smaller id. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of another label are returned whose score is at least ``lowest`` and at most ``highest``
    hundredths of the positive's: ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score``, ``negative_score``.

    All rows are compared with all anchors, in blocks of ``block_rows`` at most; of a block, an
    anchor keeps ``negatives`` rows per slot, so what is shuffled afterwards does not grow with
    hot labels or with copies of a vector.

    Rows with a null id, a null label, a null vector or a null or non-finite entry take no part,
    nor do vectors without entries or of another dimension than most (of equally many, than the
    longest). Rows equal in id, label and integer vector are one row. A row that shares the
    anchor's id is not one of its positives; rows of one id that differ otherwise are rows of
    their own, also as anchors. Too few rows: as many as there are. A positive whose score is
    below zero has an empty window. Entries so large that an inner product would leave the range
    of a long are held at the largest that cannot. Empty table: none. Other columns are not read.
    """
    rows = cut_lineage(
        integer_rows(df, anchor, id_col, vector_col, label_col, scale), "integer-rows"
    )
    counted = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    # at least a few blocks where there is work for several tasks
    row_blocks = max(-(-counted.n // block_rows), min(64, -(-counted.n // 1024)), 1)
    sizes = (max(-(-counted.anchors // block_rows), 1), row_blocks)
    key = F.md5(F.concat_ws(" ", F.col("id"), F.col("label"), F.array_join("x", ",")).cast("binary"))
    anchors = rows.filter("anchor").select(key.alias("anchor"), "id", "label", "x")
    anyone = anchors.withColumn("upper", F.array(F.lit(LONGEST))).withColumn(
        "lower", F.array(F.lit(LEAST))
    )
    nearest = _ranked(anyone, rows, sizes, True, positives)
    chosen = cut_lineage(
        nearest.groupBy("anchor").agg(
            F.array_sort(
                F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))
            ).alias("positives")
        ),
        "positives",
    )
    scores = F.transform(
        F.array_distinct(F.transform("positives", lambda p: p["minus"])), lambda minus: -minus
    )

    def share(score: Column, percent: int) -> Column:
        return score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") / F.lit(100)

    # the least and the largest whole score of each window, exact also near the ends of a long
    windows = chosen.withColumn("scores", scores).select(
        "anchor",
        "positives",
        "scores",
        F.transform("scores", lambda s: F.ceil(share(s, lowest)).cast("long")).alias("lower"),
        F.transform("scores", lambda s: F.floor(share(s, highest)).cast("long")).alias("upper"),
    )
    asking = anchors.join(windows.select("anchor", "upper", "lower"), "anchor")
    kept = _ranked(asking, rows, sizes, False, negatives)
    slots = kept.groupBy("anchor").agg(
        F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id")).alias("items")
    )

    def merged(acc, slot):
        own = F.transform(
            F.filter("items", lambda i: i["slot"] == slot), lambda i: F.struct(i["minus"], i["id"])
        )
        best = F.slice(F.array_sort(F.concat(acc["best"], own)), 1, negatives)
        return F.struct(best.alias("best"), F.concat(acc["all"], F.array(best)).alias("all"))

    kind = "array<struct<minus:bigint,id:bigint>>"
    nothing = F.struct(
        F.array().cast(kind).alias("best"), F.array().cast(f"array<{kind}>").alias("all")
    )
    # from the lowest slot upwards, so that the list of slot s is at place last - s
    answers = F.aggregate(
        F.sequence(F.size("upper") - 1, F.lit(0), F.lit(-1)), nothing, merged, lambda acc: acc["all"]
    )
    answered = windows.join(slots, "anchor").select("*", answers.alias("answers"))
    each = answered.select("anchor", "scores", "lower", "answers", F.explode("positives").alias("p"))
    at = F.array_position("scores", -F.col("p.minus")).cast("int")
    fitting = F.filter(
        F.element_at("answers", F.size("scores") - at + 1),
        lambda i: -i["minus"] >= F.element_at("lower", at),
    )
    ids = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return (
        each.select("anchor", "p", F.posexplode(fitting).alias("place", "n"))
        .join(ids, "anchor")
        .select(
            "anchor_id",
            F.col("p.id").alias("positive_id"),
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("n.id").alias("negative_id"),
            (-F.col("p.minus")).alias("positive_score"),
            (-F.col("n.minus")).alias("negative_score"),
        )
    )
