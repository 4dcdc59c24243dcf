"""Groups as a stream: rows come in order of their group, and only the unfinished group's state is carried from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(df: DataFrame, key: str, order: str = "sec", tie: str = "tx_id") -> DataFrame:
    """tie, place (1.. in the group), gap (to the row before it; null for the first), in order of `order`, then tie.

    A group may be of any length: a task holds a batch and three numbers. Null keys are one group. Whole numbers only.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.col(tie).cast("long").alias("t"))
    rows = rows.repartition("k").sortWithinPartitions("k", "o", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, whether it is null, rows so far, the last row's order
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            none = batch.column("k").is_null().to_numpy(zero_copy_only=False)
            k = pc.fill_null(batch.column("k"), 0).to_numpy()
            o = batch.column("o").to_numpy()
            same_as_held = held is not None and (k[0], none[0]) == held[:2]
            new = np.concatenate(([not same_as_held], (k[1:] != k[:-1]) | (none[1:] != none[:-1])))
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(begin >= 0, at - begin + 1, at + 1 + (held[2] if same_as_held else 0))
            gap = o - np.concatenate(([held[3] if same_as_held else 0], o[:-1]))
            held = (k[-1], none[-1], int(place[-1]), int(o[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(place, pa.int64()), pa.array(gap, pa.int64(), mask=new)], [tie, "place", "gap"])

    return rows.mapInArrow(run, f"`{tie}` long, place long, gap long")
