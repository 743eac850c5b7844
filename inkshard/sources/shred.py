"""Bodies parsed into rows inside tasks, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows collected before a batch is handed back to the JVM.
FLUSH_ROWS = 20_000


def shred(df: DataFrame, body: str, parse: Callable[[object], Iterable[tuple]], fields: str) -> DataFrame:
    """All columns but ``body``, repeated for each row that ``parse(body)`` yields, next to its ``fields``.

    No shuffle: documents are parsed where they are read, one at a time.
    """
    keys = [c for c in df.columns if c != body]
    new = StructType.fromDDL(fields)
    schema = StructType([df.schema[k] for k in keys] + new.fields)
    arrow = to_arrow_schema(schema)
    n_new = len(new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(k) for k in keys]
            source, rows = [], []

            def emit() -> pa.RecordBatch:
                index = pa.array(source, pa.int64())
                columns = list(zip(*rows)) if rows else [()] * n_new
                arrays = [c.take(index).cast(t) for c, t in zip(held, arrow.types)]
                arrays += [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(columns, arrow.types[len(keys) :])]
                return pa.RecordBatch.from_arrays(arrays, schema=arrow)

            for i, held_value in enumerate(batch.column(body)):
                value = held_value.as_py()
                if value is not None:
                    before = len(rows)
                    rows.extend(parse(value))
                    source.extend([i] * (len(rows) - before))
                if len(rows) >= FLUSH_ROWS:
                    yield emit()
                    source, rows = [], []
            if rows:
                yield emit()

    return df.mapInArrow(run, schema)
