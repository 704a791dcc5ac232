"""Numbers in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Bits of an id that count the rows inside its partition.
WITHIN = 33


def numbered(rows: DataFrame, *keys: str, number: str = "number") -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``keys`` (no ties).

    Ranges of the keys are sorted each by a task, which numbers its own rows.
    What lies before a range is the sum of the sizes of those before it: one
    number a partition, which the driver adds up.
    """
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(number, F.monotonically_increasing_id())
    inside = staged(ranges, "numbered")
    part = F.shiftright(number, WITHIN)
    before, sizes = 0, inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = []
    for r in sorted(sizes.collect(), key=lambda r: r.part):
        starts += [F.lit(r.part), F.lit(before).cast("bigint")]
        before += r.n
    if not starts:
        return inside
    offset = F.element_at(F.create_map(*starts), part)
    return inside.withColumn(number, offset + F.col(number).bitwiseAND(F.lit((1 << WITHIN) - 1)))
