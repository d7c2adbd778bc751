"""Numbers 1..n in an order, over a whole table or within groups, without a group or the table in one task.

Rows are dealt to ranges of (group, order), sorted there and written once with their place; the
rows of each (group, range) are counted, and the counts of the ranges before are added to the
places. Only the counts, a row for each group and range it touches, are summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import staged

#: monotonically_increasing_id() holds the partition above these bits and the row's place below.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[tuple[Column, str]], groups: list[str] = (), name: str = "number") -> DataFrame:
    """rows with a column of numbers from 1 in the given order (within equal values of the groups; null is one value).

    order: columns with "asc_nulls_last" or another of Column's sort orders. Rows that tie in the whole order are
    numbered as they come; give a full order where reruns must agree. An empty table gives an empty table. Rows that
    agree in the groups and in the whole order share one range.
    """
    keys = [f"_group{i}" for i in range(len(groups))]
    held = rows.select(F.struct("*").alias("_row"), *[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], *[c.alias(f"_order{i}") for i, (c, _) in enumerate(order)])
    by = [F.col(k).asc_nulls_first() for k in keys] + [getattr(F.col(f"_order{i}"), how)() for i, (_, how) in enumerate(order)]
    ranged = held.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = staged(ranged.select("_row", *keys, F.monotonically_increasing_id().alias("_id")), "numbered")
    part, place = F.shiftrightunsigned("_id", PLACE_BITS), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = placed.groupBy(*keys, part.alias("_part")).agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    if keys:
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
        offsets = counts.select(*[F.col(k).alias(f"{k}o") for k in keys], F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_add"))
    else:  # a row for each partition
        total, adds = 0, []
        for r in sorted(counts.collect(), key=lambda r: r["_part"]):
            adds.append((r["_part"], total - r["_first"] + 1))
            total += r["_n"]
        offsets = rows.sparkSession.createDataFrame(adds, "_p bigint, _add bigint")
    on = part == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}o"))
    return placed.join(offsets, on).select("_row.*", (place + F.col("_add")).alias(name))
