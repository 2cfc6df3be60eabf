"""Functions over Arrow batches inside a plan, for what Spark's own expressions cannot do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seqforge.session import ship_package

#: Rows and bytes of a batch: texts may be long, so rows alone are no bound.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that a function takes at once: what it makes of them is many times as large.
SLICE_BYTES = 1 << 18


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batch: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch in runs of less than ``SLICE_BYTES`` beside their last one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    run = np.r_[0, ends[:-1]] // SLICE_BYTES if len(ends) else ends
    cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(ends)]
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if end > begin:
            yield batch.slice(begin, end - begin)


def arrow_column(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str, column: Column) -> Column:
    """``make`` is called once for each task and gives the function over texts, which takes a batch by its :func:`slices`; rows keep
    their order."""
    spark = SparkSession.active()
    ship_package(spark)
    bound_batches(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = make()
        for batch in batches:
            for part in slices(batch):
                yield function(part)

    return F.arrow_udf(run, kind)(column)
