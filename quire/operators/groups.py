"""Groups of bounded size (a page, a document) through numpy, many groups per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = Callable[[dict[str, np.ndarray]], dict[str, Sequence]]


def per_group(rows: DataFrame, by: str, cols: Sequence[str], run: Run, out: str) -> DataFrame:
    """(by, out...) of run(columns as arrays, rows in order of cols) on each group of rows; out: schema of run's columns.

    A group is one row of arrays, so that a batch holds many groups and no group costs a call into Python of its own.
    """
    kind = rows.schema[by].dataType.simpleString()
    grouped = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    names = [x.strip().split(" ")[0] for x in out.split(",")]

    def batches(it):
        for batch in it:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            fields = {c: lists.flatten().field(i) for i, c in enumerate(cols)}
            arrays = {c: v.to_numpy(zero_copy_only=False) for c, v in fields.items()}
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            got, at = [], []
            for i, e in enumerate(ends.tolist()):
                s = int(ends[i - 1]) if i else 0
                g = run({c: v[s:e] for c, v in arrays.items()})
                got.append(g)
                at += [i] * len(g[names[0]])
            cols_out = [pa.array([x for g in got for x in g[n]]) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols_out], names=[by, *names]).cast(target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{by}` {kind}, {out}"
    target = to_arrow_schema(StructType.fromDDL(schema))
    return grouped.mapInArrow(batches, schema)
