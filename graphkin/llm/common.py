"""Shared folders, checkpoints and table access for the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

#: The separators of words, as a character class of both Java's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests only) a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="graphkin-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again.

    Compressed columns take a fraction of the space of a checkpoint's rows, and
    later steps read only those they use.
    """
    path = shared_dir(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path  # for tidy()
    return out


def shared_dir(spark: SparkSession, name: str) -> str:
    """The URI of a new folder below the shared one."""
    root = shared_root(spark)
    return new_path(f"{root if '://' in root else 'file://' + root}", name)


def new_path(folder: str, name: str = "part") -> str:
    """A URI of its own in the folder; for tasks too."""
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession, *done: DataFrame | str | None) -> None:
    """Delete checkpointed tables and folders that no later step reads.

    The driver's collectors run as well: Spark's cleaner deletes the shuffle
    files of finished steps only once their plans are collected, which a driver
    with little to do may put off until the disks are full.
    """
    for one in done:
        uri = one if isinstance(one, str) else getattr(one, "_step", None)
        if uri:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(uri: str):
    """(file system, path) of a URI, for the binary files that Spark's own writers have no format for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Draft:
    """A file written under a name of its own and renamed when whole, so that a retried task does no harm: the first whole file stays."""

    def __init__(self, uri: str) -> None:
        self.uri, (self.fs, self.path) = uri, store(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.draft, compression=None, buffer_size=1 << 20)

    def write(self, part: bytes) -> None:
        self.out.write(part)

    def done(self) -> None:
        from pyarrow.fs import FileType

        self.out.close()
        if self.fs.get_file_info(self.path).type == FileType.NotFound:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)


def put(uri: str, parts) -> int:
    """Write the parts as one file; its size."""
    file, size = Draft(uri), 0
    for part in parts:
        file.write(part)
        size += len(part)
    file.done()
    return size


def ddl(kind: DataType) -> str:
    """A type as Spark's parser reads it, names of nested fields quoted."""
    if isinstance(kind, StructType):
        return f"struct<{', '.join(f'{_quoted(f.name)}: {ddl(f.dataType)}' for f in kind)}>"
    if isinstance(kind, ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{ddl(kind.keyType)}, {ddl(kind.valueType)}>"
    return kind.simpleString()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fields(columns: list[StructField] | StructType) -> str:
    """The columns of a schema for mapInArrow."""
    return ", ".join(f"{_quoted(f.name)} {ddl(f.dataType)}" for f in columns)


def trimmed(run):
    """run(batches) for mapInArrow, after which the worker gives back the memory that its allocators keep: workers are used again by other steps."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return work


def release() -> None:
    """Give unused memory back to the system, where the allocators can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the largest counts, at most so many: all from some step of a logarithmic scale on.

    A histogram of the scale, of a few thousand rows, says where that step is,
    so no task sends more than its share of the result.
    """
    step = F.floor(F.log2(F.col(count)) * 64)
    bars = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for bar in bars:
        total += bar["n"]
        if total > most:
            break
        least = bar["step"]
    return counts.where(F.lit(False) if least is None else step >= least)
