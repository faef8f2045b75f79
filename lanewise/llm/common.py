"""What the operators share: words, row-wise text functions, block counts."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
#: A-Z lower-cased, everything outside words turned into a space. Words are ``[0-9a-z\x80-\xff]+`` in
#: UTF-8, which is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in characters.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text; none for a null."""
    return text.translate(WORD_BYTES).split() if text else []


def annotate(df: DataFrame, column: str, make, fields: list[T.StructField]) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct) and ``fields``, worked out from one string column.

    ``make()`` is called once per task and returns a function from a list of UTF-8 texts (or nulls)
    to one list per field. Input columns stay inside ``row``, so that their names never clash.
    """
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    at = df.columns.index(column)
    schema = T.StructType([source.schema["row"], *fields])

    def run(batches):
        fn = make()
        types = [pa_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, pc.struct_field(batch.column(0), at)):
                row = part.column(0)
                out = fn(pc.struct_field(row, at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [row, *[pa.array(v, t) for v, t in zip(out, types, strict=True)]],
                    names=["row", *[f.name for f in fields]],
                )

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, texts: pa.Array) -> list[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE_BYTES`` of text, so that word lists stay small."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes.astype(np.int64) + 64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def pa_type(t: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
    return pa.list_(pa_type(t.elementType)) if isinstance(t, T.ArrayType) else simple[type(t)]


#: The optimizer's word for a size it does not know is larger than this.
UNKNOWN = 1 << 60


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes in a column, counted."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def blocks_for(df: DataFrame, column: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the rows make; at least one per core.

    By the optimizer's estimate (the file size for a plain scan), or counted where there is none.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = text_bytes(df, column) if size > UNKNOWN else size
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // block_bytes))
