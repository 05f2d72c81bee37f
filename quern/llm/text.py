"""What the text operators have in common: words, Arrow batches and row identity."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quern.session import ship

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch that are worked on together; bounds the memory of a Python worker.
ROWS = 256
#: Estimated bytes below which a table counts as small.
FEW_BYTES = 16 << 20


def words(text: str) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def n_words(text: Column) -> Column:
    """Number of words on the JVM side; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small table in fewer files than there are cores, as a file may be one split.

    Only where the rows lie changes. The size is the optimizer's estimate, and files are listed for small tables alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < FEW_BYTES
    return df.repartition(cores) if small and 0 < len(df.inputFiles()) < cores else df


_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What the tasks of owner keep in this Python worker for those that follow.

    Spark gives a worker to the tasks of any stage, so what others kept goes: else the machines of a stage that is over take their
    memory beside the work of the next one for as long as the worker lives.
    """
    if others := _held.keys() - {owner}:
        for k in others:
            del _held[k]
        gc.collect()  # machines refer to themselves
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()  # Arrow and the C library keep what is freed, too
    return _held.setdefault(owner, {})


def by_rows(df: DataFrame, inputs: list[str], kept: list[str], work: Callable[..., list[list]], made: str, owner: str = "") -> DataFrame:
    """The kept columns and those of the DDL string made, which work returns for slices of at most ROWS rows.

    work gets the inputs as one list each. Kept columns pass through as Arrow buffers, but for those that are called like a column of
    made, which are left out. mapInArrow, so there is no shuffle, no
    state between rows, and a lost executor only repeats its own tasks. owner names what work keeps with held().
    """
    ship(df.sparkSession)
    new = StructType.fromDDL(made)
    target = list(to_arrow_schema(new))
    kept = [c for c in dict.fromkeys(kept) if c not in new.names]
    both = list(dict.fromkeys([*inputs, *kept]))
    places = [both.index(c) for c in inputs]
    n_kept = [both.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(owner)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = work(*[part.column(i).to_pylist() for i in places])
                arrays = [pa.array(v, f.type) for v, f in zip(out, target, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in n_kept], *arrays], names=[*[part.schema.names[i] for i in n_kept], *[f.name for f in target]])

    fields = [StructField(c, df.schema[c].dataType, True) for c in kept] + [StructField(f.name, f.dataType, True) for f in new]
    return dealt(df.select(*both)).mapInArrow(run, StructType(fields))


def positional(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns renamed by place, so that no name of theirs clashes with a computed one; and the way back."""
    names = df.columns
    return df.select(*[df[c].alias(f"__{i}") for i, c in enumerate(names)]), lambda out: out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
