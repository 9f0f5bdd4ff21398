"""Bodies of requests from files: plain, gzip or deflate by what they hold, inflated up to a bound and no further."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOO_LARGE, BROKEN = "payload too large", "bad request"
FILES = "path string, modificationTime timestamp, length long, content binary"
LARGEST = 1 << 20
#: Tasks for each core that list folders; Spark's default is one for each path, up to 10000, whenever it lists.
LISTING = 4
#: What a file counts besides its bytes when files are dealt into tasks: some hundred small ones each.
OPENING = 1 << 20


@contextmanager
def many_files(spark: SparkSession):
    """The session's settings for folders of very many small files, put back behind it. A stream lists and reads by the session's
    settings for as long as it runs, whatever copy of the session it has, so they must hold until it ends."""
    own = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": str(OPENING)}
    old = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write_bodies(rows: DataFrame, path: str) -> None:
    """A file for each row (name, codec: none, gzip or deflate; body: text) below a folder that driver and executors share.

    Spark's own writers make a folder, a file and its checksum for each row, which took some 20 ms a file on local disks. A task that
    runs again writes the same files. The path is one that pyarrow can open.
    """

    def run(batches) -> Iterator:
        import gzip

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        pack = {"none": bytes, "gzip": gzip.compress, "deflate": zlib.compress}
        files, below = FileSystem.from_uri(path)
        for codec in pack:
            files.create_dir(f"{below}/{codec}")
        for batch in batches:
            for name, codec, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with files.open_output_stream(f"{below}/{codec}/{name}", compression=None) as out:
                    out.write(pack[codec](body.encode()))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])

    rows.select("name", "codec", "body").mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def _compressed(data: bytes) -> bool:
    gzip = data[:2] == b"\x1f\x8b"
    return gzip or (len(data) >= 2 and data[0] & 15 == 8 and data[0] >> 4 < 8 and int.from_bytes(data[:2]) % 31 == 0)


def inflate(data: bytes, largest: int) -> tuple[bytes | None, str | None]:
    """The bytes, or what is wrong. No more than `largest` + 1 bytes are ever made, however much the data would inflate to."""
    if not _compressed(data):
        return (None, TOO_LARGE) if len(data) > largest else (data, None)
    out = b""
    try:
        while data:
            stream = zlib.decompressobj(47)  # gzip or zlib, as its header says
            out += stream.decompress(data, largest + 1 - len(out))
            if len(out) > largest:
                return None, TOO_LARGE
            if not stream.eof:
                return None, BROKEN
            data = stream.unused_data  # gzip files may have several members
    except zlib.error:
        return None, BROKEN
    return out, None


def read_bodies(spark: SparkSession, path: str, largest: int = LARGEST, streaming: bool = False, **options) -> DataFrame:
    """One row for each file below a folder: path, body (text), fault. What is too large, broken or no UTF-8 has a fault and no body.

    Files that are larger than `largest` as they lie are not opened; empty ones give no row. In tasks a file's own bytes and `largest` more are held.
    """
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    with many_files(spark):  # a batch lists its files here
        files = reader.options(**options).load(path)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bodies, faults = [], []
            for i in range(batch.num_rows):
                data, fault = inflate(batch.column(1)[i].as_py() or b"", largest)
                try:
                    bodies.append(None if data is None else data.decode())
                except UnicodeDecodeError:
                    bodies.append(None)
                    fault = BROKEN
                faults.append(fault)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(faults, pa.string())], ["path", "body", "fault"])

    schema = "path string, body string, fault string"
    small = files.filter(F.col("length") <= largest).select("path", "content").mapInArrow(run, schema)
    large = files.filter(F.col("length") > largest).select("path", F.lit(None).cast("string").alias("body"), F.lit(TOO_LARGE).alias("fault"))
    return small.unionByName(large)
