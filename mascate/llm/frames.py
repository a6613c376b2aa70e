"""What the operators share: cutting lineage, and running a function over whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mascate.sources.shared import kept, shared_folder

#: Texts that a task has as Python strings at a time.
SLICE = 512
#: The characters that part words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: a lost executor takes none of them along."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, so that Spark knows their true size.

    A join broadcasts the table only if that size is under the session's threshold.
    """
    return kept(frame, "table")


def map_texts(
    frame: DataFrame,
    keep: list[str],
    text: str,
    start: Callable[[], Callable[[list[str]], list[pa.Array]]],
    fields: str,
) -> DataFrame:
    """The columns ``keep`` and what ``start()(texts)`` gives for each batch of ``text`` (NULL: empty).

    ``text`` is a column, or ``struct.field`` for a field of a struct column among ``keep``.
    ``start`` runs once in each task, so that what it builds serves all of the task's batches.
    ``fields`` is the schema of the added columns.
    """
    added = StructType.fromDDL(fields)
    schema = StructType([frame.schema[name] for name in keep] + added.fields)
    column, _, field = text.partition(".")
    place = frame.schema[column].dataType.names.index(field) if field else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            values = batch.column(column)
            if place is not None:
                values = pc.struct_field(values, [place])
            columns = work([value or "" for value in values.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in keep] + columns, names=schema.names
            )

    return frame.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, where their names cannot clash with an operator's."""
    return docs.select(F.struct("*").alias("row"))


def words_of(text: Column) -> Column:
    """The words of a text, parted by the ASCII white space; none for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda word: word != "")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)
