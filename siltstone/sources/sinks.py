"""Sinks: containers of chunks, compressed groups, restored files, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import prepare, written


def write_containers(placed: DataFrame, path: str) -> None:
    """Chunks with their ``container_id`` and ``offset``, a folder for every 1024 containers."""
    placed.withColumn("shelf", F.floor(F.col("container_id") / 1024)).write.mode("overwrite").partitionBy("shelf").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, content) of all containers, from which files can be restored."""
    return spark.read.parquet(path).select("chunk_id", "content")


def read_chunk(spark: SparkSession, path: str, chunk_id: int) -> DataFrame:
    """One chunk of the containers; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col("chunk_id") == chunk_id).drop("shelf")


def write_groups(groups: DataFrame, path: str, method: str) -> None:
    """Compressed groups of a method, in a folder of its own."""
    groups.write.mode("overwrite").parquet(f"{path}/{method}")


def write_restored(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").parquet(path)


def _write_file(batches, folder: str, names: dict[int, str] | None = None):
    """Appends the parts of each file, which come in order, to a file of an attempt's own; a whole one gets its name."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs
    from pyspark import TaskContext

    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    attempt = TaskContext.get().taskAttemptId()
    out = now = None
    done: list[tuple] = []

    def close() -> None:
        nonlocal out
        if out is not None:
            out.close()
            system.move(now["temporary"], now["name"])
            done.append((now["id"], now["path"], now["length"], now["digest"].hexdigest()))
            out = None

    for batch in batches:
        for file_id, path, content in zip(*(batch.column(c) for c in ("file_id", "path", "content"))):
            if now is None or now["id"] != file_id.as_py():
                close()
                name = f"{base}/{path.as_py()}"
                now = {"id": file_id.as_py(), "path": path.as_py(), "name": name, "temporary": f"{name}.{attempt}", "length": 0, "digest": hashlib.sha256()}
                system.create_dir(name.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(now["temporary"])
            part = content.as_py() or b""
            out.write(part)
            now["length"] += len(part)
            now["digest"].update(part)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(4)], names=["file_id", "path", "length", "sha256"])
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(4)], names=["file_id", "path", "length", "sha256"])


def write_files(parts: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Files of any size below a folder that all executors share, from (file_id, seq, content) and (file_id, path, relative);
    returns (file_id, path, length, sha256).  A task writes a file front to back and holds one chunk of it."""
    prepare(parts.sparkSession)
    rows = files.select("file_id", "path").join(parts, "file_id", "left").select("file_id", "path", "seq", "content")
    dealt = rows.repartition("file_id").sortWithinPartitions("file_id", "seq")
    return written(dealt.mapInArrow(lambda b: _write_file(b, folder), "file_id long, path string, length long, sha256 string"), "files")


def write_report(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)  # a summary is one row


def append_histogram(histogram: DataFrame, path: str) -> None:
    histogram.coalesce(1).write.mode("append").option("header", True).csv(path)  # a row for each size
