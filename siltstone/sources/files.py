"""Sources: directories of files, tables of texts, natural path order, and byte ranges of large files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def natural_key(path: Column) -> Column:
    """Sorts like a person would: without regard to case, digit runs by value, digits before letters.
    Every digit run is marked, stripped of leading zeros, and preceded by its number of digits."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"\d+|\D+"), F.lit(0))

    def one(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, one), "")


def first_files(files: DataFrame, n: int | None, path: str = "path") -> DataFrame:
    """The first ``n`` files in natural order (fewer if there are fewer; None: all)."""
    return files if n is None else files.orderBy(natural_key(F.col(path)), path).limit(max(0, n))


def _plain(path: Column) -> Column:
    """A path without scheme and leading slashes, as sources name it in different ways."""
    return F.regexp_replace(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*", "")


def files_listed(spark: SparkSession, folder: str, pattern: str = "*", n: int | None = None) -> DataFrame:
    """(file_id, path, length) of the files below a folder, empty ones too, numbered in natural order; names that start
    with a dot or an underscore are left out, as Spark's own sources do."""
    from siltstone.operators.ids import dense_id
    from siltstone.session import prepare

    prepare(spark)
    spark.dataSource.register(FileListSource)
    found = spark.read.format("file_list").option("pattern", pattern).load(folder)
    listed = first_files(found, n).withColumn("k", natural_key(F.col("path")))
    return dense_id(listed, ["k", "path"], "file_id").select("file_id", "path", "length")


def files_from_dir(spark: SparkSession, folder: str, pattern: str = "*", n: int | None = None) -> DataFrame:
    """(file_id, path, length, content) of the files below a folder, numbered in natural order.  Content of
    Spark's binaryFile source: a row for each file of less than 2 GiB; larger files: ``files_in_ranges``."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files_listed(spark, folder, pattern, n).withColumn("p", _plain(F.col("path")))
    whole = files.join(content.select(_plain(F.col("path")).alias("p"), "content"), "p", "left")  # that source skips empty files
    return whole.select("file_id", "path", "length", F.coalesce("content", F.lit(b"")).alias("content"))


def files_from_table(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """A table's rows as files: texts as UTF-8 bytes, null content as empty."""
    content = F.col(content_col)
    if dict(df.dtypes)[content_col] != "binary":
        content = F.encode(content.cast("string"), "UTF-8")
    content = F.coalesce(content, F.lit(b""))
    return df.select(F.col(id_col).cast("long").alias("file_id"), F.col(id_col).cast("string").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _found(path: str, pattern: str = "*") -> list:
    """The files below a folder, as pyarrow lists them."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) or [system.get_file_info(base)]
    below = lambda f: f.path[len(base) :].split("/")
    return [f for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and not any(x[:1] in ("_", ".") for x in below(f))]


class _Listed(InputPartition):
    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows


class _ListReader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self):
        rows = [(f.path, f.size) for f in _found(self.path, self.pattern)]
        return [_Listed(rows[k : k + 10000]) for k in range(0, len(rows), 10000)] or [_Listed([])]

    def read(self, partition):
        yield from partition.rows


class FileListSource(DataSource):
    """``spark.read.format("file_list").load(folder)``: path and length of every file below."""

    @classmethod
    def name(cls) -> str:
        return "file_list"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema):
        return _ListReader(self.options["path"], self.options.get("pattern", "*"))


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        return [_Range(f.path, a, min(f.size, a + self.size)) for f in _found(self.path) for a in range(0, f.size, self.size)] or [_Range("", 0, 0)]

    def read(self, partition):
        from pyarrow import fs

        if partition.end > partition.start:
            system = fs.FileSystem.from_uri(self.path)[0] if ":/" in self.path else fs.LocalFileSystem()
            with system.open_input_file(partition.path) as f:
                f.seek(partition.start)
                yield partition.path, partition.start, f.read(partition.end - partition.start)


class ByteRangeSource(DataSource):
    """``spark.read.format("byte_ranges").option("size", n).load(folder)``: files in ranges of ``size`` bytes (a
    multiple of the chunk size, so that ranges never split a chunk), a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, content binary"

    def reader(self, schema):
        return _RangeReader(self.options["path"], int(self.options.get("size", 128 << 20)))


def files_in_ranges(spark: SparkSession, folder: str, chunk_size: int, n: int | None = None, size: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(file_id, path, length) of the files below a folder, and their content as (file_id, start, content) in ranges of
    about ``size`` bytes that never split a chunk, so that files of any size come in."""
    files = files_listed(spark, folder, n=n)
    ranges = byte_ranges(spark, folder, max(1, size // chunk_size) * chunk_size)
    parts = ranges.withColumn("p", _plain(F.col("path"))).join(files.select("file_id", _plain(F.col("path")).alias("p")), "p")
    return files, parts.select("file_id", "start", "content")


def byte_ranges(spark: SparkSession, folder: str, size: int = 128 << 20) -> DataFrame:
    from siltstone.session import prepare

    prepare(spark)
    spark.dataSource.register(ByteRangeSource)
    return spark.read.format("byte_ranges").option("size", size).load(folder)
