"""What the corpus operators share: scratch tables, hashed document splits, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the separators of words: space and U+0009 to U+000D (what bytes.split() splits on).
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that is handed on; texts are long, so batches are kept short.
BATCH_ROWS = 512
#: Bits of the table that tells which rows may join: eight a member, within these bounds.
BITS = (1 << 18, 1 << 27)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, gives the optimizer true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if folder.startswith((scratch_root(spark), scratch_root(spark).replace("file://", "file:"))):
            path.getFileSystem(conf).delete(path, True)


def divide_by_members(rows: DataFrame, key: Column, members: DataFrame, member: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key may be among the members' keys, those whose key surely isn't), keys being 64-bit hashes.

    An exact join follows for the former; the latter needn't be shuffled. The
    members' bits are grouped to words of 64, so what is broadcast has at
    most BITS[1] / 64 rows (two million) whatever the input; where members
    fill the table more rows may be among them, none is lost.
    """
    bits = min(max(1 << (8 * members.count()).bit_length(), BITS[0]), BITS[1])
    place = lambda k: F.pmod(k, F.lit(bits))
    one = F.expr("shiftleft(1L, cast(place__ & 63 as int))")
    words = members.select(place(member).alias("place__")).groupBy(F.shiftright("place__", 6).alias("word__")).agg(F.bit_or(one).alias("bits__"))
    held = rows.withColumn("place__", place(key)).withColumn("word__", F.shiftright("place__", 6)).join(F.broadcast(words), "word__", "left")
    among = F.coalesce(F.col("bits__").bitwiseAND(one) != 0, F.lit(False))
    return held.where(among).select(*rows.columns), held.where(~among).select(*rows.columns)


def likely_members(rows: DataFrame, key: Column, members: DataFrame, member: Column) -> DataFrame:
    """The rows whose key may be among the members' keys, for an exact join to follow."""
    return divide_by_members(rows, key, members, member)[0]


def crc_bucket(doc_id: str, buckets: int) -> Column:
    """crc32(doc_id as text) mod buckets; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string")) % buckets


def blobs(array: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string of an Arrow array; null gives the empty string."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    for value in array.cast(kind):
        yield value.as_py() or b""


def lower(data: bytes) -> bytes:
    """UTF-8 bytes in lower case."""
    return data.lower() if data.isascii() else data.decode("utf-8", "replace").lower().encode()


def per_document(docs: DataFrame, columns: list[str], make: Callable[[], Callable[[bytes], tuple]], schema: str, text: str = "text") -> DataFrame:
    """Run a function of one whole text over every row, in Arrow batches.

    ``make`` builds the function once a task (models, memos); it returns a
    tuple in the order of ``schema``'s last fields, after the columns kept.
    """
    kept = len(columns)
    spark_schema = docs.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spark_schema)
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = [one(blob) for blob in blobs(part.column(kept))]
                made = [pa.array(values, out.field(kept + i).type) for i, values in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(out.field(i).type) for i in range(kept)), *made], schema=out)

    return docs.select(*(F.col(c) for c in columns), F.col(text)).mapInArrow(run, spark_schema)


def keep_rows(docs: DataFrame, verdict: Callable[[], Callable[[bytes], bool]], text: str = "text") -> DataFrame:
    """Keep the rows whose whole text the verdict accepts, all columns as they are."""
    at = docs.columns.index(text)

    def run(batches):
        one = verdict()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                yield part.filter(pa.array([one(blob) for blob in blobs(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def with_made(docs: DataFrame, make: Callable[[], Callable[[bytes], tuple]], schema: str, text: str = "text") -> DataFrame:
    """All columns as they are, and after them what a function of the whole text makes (a tuple in the order of ``schema``)."""
    at = docs.columns.index(text)
    made_schema = docs.sparkSession.createDataFrame([], schema).schema
    out_schema = StructType([*docs.schema.fields, *made_schema.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(made_schema)
        one = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                rows = [one(blob) for blob in blobs(part.column(at))]
                made = [pa.array(values, kinds.field(i).type) for i, values in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *kinds.names])

    return docs.mapInArrow(run, out_schema)
