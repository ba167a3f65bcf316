"""Session defaults and the shared work folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators rely on; a cluster's own values win over these.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets the indexes of a small sample reach the row-group filter one by one
    "spark.sql.parquet.pushdown.inFilterThreshold": "2048",
    # call sites of single Column operations: not worth a round trip each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is chosen only where the setting is missing and Spark runs
    in one process, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="colloquy-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the work root nobody has used yet (not created)."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


class Files:
    """The few file-system questions the table layouts need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isDirectory()

    def size(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getLen()

    def children(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def has_parquet(self, path: str) -> bool:
        """Whether any parquet file lies at or below ``path``; stops at the first."""
        if not self.exists(path):
            return False
        walk = self._fs.listFiles(self._path(path), True)
        while walk.hasNext():
            if walk.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def read_text(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_start(self, path: str, size: int) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_text(self, path: str, text: str) -> None:
        """Write a file that must not be there yet."""
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished Spark write lies at ``path``."""
    return Files(spark, path).exists(f"{path}/_SUCCESS")


def content_mark(df: DataFrame, *columns: str) -> str:
    """A mark of the rows' content in some columns, whatever their order: rows, and the exclusive or of their hashes."""
    n, mark = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*columns))).first()
    return f"{n} rows {(mark or 0) & (1 << 64) - 1:016x}"


def input_mark(df: DataFrame, key: str) -> str:
    """A mark of a table: the files it is read from, which change with its version, and the keys that it holds of them."""
    files = hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()[:16]
    return f"files {files}, {content_mark(df, key)}"


def write_once(df: DataFrame, path: str, made_by: object = None) -> DataFrame:
    """Write a table and read it back; one that is complete there already is not computed again.

    ``made_by`` says what the table depends on: options, protocol, turn, and the mark of its input
    (``content_mark``, ``input_mark``). It is kept next to the table with the columns; one that was made otherwise raises.
    """
    spark = df.sparkSession
    files = Files(spark, path)
    mark = f"{path}.made_by"
    own = f"{df.schema.simpleString()}\n{made_by!r}"
    if complete(spark, path):
        other = files.read_text(mark)
        if other is not None and other != own:
            raise RuntimeError(f"{path} was made with other options or input; take another folder, or remove it\nthere: {other}\nhere: {own}")
    else:
        files.write_text(mark, own)
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
