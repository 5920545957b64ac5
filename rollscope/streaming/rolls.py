"""Roll files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rollscope.operators.counts import name_state_counts
from rollscope.operators.enrich import join_state_corpus, state_to_lang
from rollscope.sources.shared import delete_folder


def stream_rolls(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)


class VersionedTable:
    """A table of the newest row of each key, in folders that a marker commits.

    A batch is written to a folder of its own name and becomes part of the table by a marker file of that name, which is
    made in one step after the folder is whole. So a reader sees all of a batch or nothing of it, a batch that died half-way
    is written anew, and one that is committed is not written again. `compact` folds the committed batches into one
    folder; it is a version like them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, name: str):
        return self._paths(f"{self.path}/_commits/{name}")

    def commit(self, rows: DataFrame, name: str) -> bool:
        """Write rows as version `name`, unless it is committed; says whether they were written."""
        if self._store.exists(self._marker(name)):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._store.createNewFile(self._marker(name))
        return True

    def versions(self) -> list[tuple[int, str]]:
        """(batch, folder name) of the newest compacted version and of the batches after it, in order."""
        folder = self._paths(f"{self.path}/_commits")
        names = [f.getPath().getName() for f in self._store.listStatus(folder)] if self._store.exists(folder) else []
        found = sorted((int(n.split("-")[1]), n) for n in names)
        base = max((b for b, n in found if n.startswith("all-")), default=-1)
        return [(b, n) for b, n in found if b > base or b == base and n.startswith("all-")]

    def write_batch(self, rows: DataFrame, batch: int) -> bool:
        """Commit a batch, unless it is committed or folded into a compacted version; says whether it was written."""
        base = max((b for b, name in self.versions() if name.startswith("all-")), default=-1)
        return batch > base and self.commit(rows, f"batch-{batch}")

    def read(self) -> DataFrame | None:
        """The newest row of each key; None before the first commit."""
        out = None
        for batch, name in self.versions():
            rows = self.spark.read.parquet(f"{self.path}/{name}").withColumn("_batch", F.lit(batch))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return None
        values = [c for c in out.columns if c not in self.keys and c != "_batch"]
        newest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_newest"))
        return newest.select(*self.keys, "_newest.*")

    def compact(self) -> None:
        """Fold what is committed into one version and delete the folders before it; readers of those must have finished."""
        found = self.versions()
        if len(found) < 2:
            return
        self.commit(self.read(), f"all-{found[-1][0]}")
        for _, name in found:
            self._store.delete(self._marker(name), False)
            delete_folder(self.spark, f"{self.path}/{name}")


def incremental_counts(names: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running (last_name, state) counts of a stream of name rows, as a `VersionedTable` at `out`; batches hold changed keys only."""
    table = counts_table(names.sparkSession, out)
    return (
        name_state_counts(names)
        .writeStream.outputMode("update")
        .foreachBatch(lambda rows, batch: table.write_batch(rows, batch) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counts_table(spark: SparkSession, out: str) -> VersionedTable:
    return VersionedTable(spark, out, ["last_name", "state"])


def stream_last_state(
    names: DataFrame, column: str, corpus: DataFrame, out: str, checkpoint: str, time: str | None = None, delay: str = "1 day"
) -> StreamingQuery:
    """Arriving names with their state distributions, a stream-static join; each raw name is written once.

    With an event-time column a name counts as a repeat for `delay` after it was seen, and the state holds the names of that time
    only: one that comes again later is written again, and rows later than the watermark are dropped. Without one the state
    grows with the distinct names of the stream.
    """
    if time:
        rows = names.withWatermark(time, delay).dropDuplicatesWithinWatermark([column])
    else:
        rows = names.dropDuplicates([column])
    rows = join_state_corpus(rows, column, corpus)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def stream_state_to_lang(rows: DataFrame, column: str, dimension: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving rows with the languages of their state."""
    rows = state_to_lang(rows, column, dimension)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
