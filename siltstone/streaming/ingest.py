"""Incremental ingest: files that arrive in micro-batches, deduplicated against all that came before.

Each batch adds the chunks that the index does not have yet and the recipes of its files.  The fingerprints of a
batch of at most ``BROADCAST_CHUNKS`` different chunks are broadcast, so that the index is only scanned for them (one
column) and none of it is shuffled; a larger batch is joined by a shuffle.  Both tables
are folders of one Parquet part for each batch, replaced as a whole when a batch is replayed, so that every
batch takes effect once.  Grouping and compression run as a batch job over the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.config import Config
from siltstone.operators import chunking, dedup
from siltstone.operators.ids import dense_id

UNIQUE = "fp string, size int, content binary, file_id long, seq int, batch long"
#: Fingerprints that are broadcast at most, about 130 bytes each.
BROADCAST_CHUNKS = 1 << 17
RECIPES = "file_id long, seq int, fp string, batch long"


class Index:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.base}/{table}"
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def unique(self) -> DataFrame:
        return self._read("unique", UNIQUE)

    def recipes(self) -> DataFrame:
        return self._read("recipes", RECIPES)

    def add(self, files: DataFrame, batch: int, config: Config) -> None:
        """Adds a batch; a replay writes the same again."""
        rows = dedup.with_fingerprint(chunking.chunks(files, config)).persist()
        first = rows.groupBy("fp").agg(F.min(F.struct("file_id", "seq")).alias("at")).select("fp", "at.*").persist()
        wanted = first.select("fp")
        past = self.unique().where(F.col("batch") != batch).select("fp")
        known = past.join(F.broadcast(wanted) if first.count() <= BROADCAST_CHUNKS else wanted, "fp", "left_semi")
        new = first.join(known, "fp", "left_anti").select("file_id", "seq")
        fresh = rows.join(new, ["file_id", "seq"]).select("fp", "size", "content", "file_id", "seq")
        fresh.write.mode("overwrite").parquet(f"{self.base}/unique/batch={batch}")
        rows.select("file_id", "seq", "fp").write.mode("overwrite").parquet(f"{self.base}/recipes/batch={batch}")
        first.unpersist()
        rows.unpersist()

    def numbered(self) -> tuple[DataFrame, DataFrame]:
        """Unique chunks with dense ids in the order of files, and recipes of these ids."""
        unique = dense_id(self.unique().drop("batch"), ["file_id", "seq"], "chunk_id")
        return unique, self.recipes().join(unique.select("fp", "chunk_id"), "fp").select("file_id", "seq", "chunk_id")


def ingest(files: DataFrame, base: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Starts the ingest of a stream of (file_id, content); processes what is there and ends."""
    index = Index(files.sparkSession, base)
    return (
        files.writeStream.foreachBatch(lambda df, batch: index.add(df, batch, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_fingerprints(files: DataFrame, config: Config = Config()) -> DataFrame:
    """A stream of fingerprints, each one once, with the state kept by Spark."""
    return dedup.with_fingerprint(chunking.chunks(files, config)).select("fp", "size").dropDuplicates(["fp"])
