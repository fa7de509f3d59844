"""Incremental upserts from a stream of records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.relational import latest
from lectern.sources import storage


class VersionedIndex:
    """An index as a folder of versions; readers follow the newest numbered pointer, so they never see half a version or none.

    Records are spread over ``buckets`` by id and a batch rewrites only the buckets it touches. The last ``keep`` pointers and the
    folders they name stay for readers that started before; older ones are removed. There may be one writer at a time: a second one
    that takes the same number fails.
    """

    def __init__(self, spark, path: str, schema: str, order: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schema, self.order, self.buckets, self.keep = spark, path.rstrip("/"), schema, order, buckets, keep

    def _pointers(self) -> list[str]:
        return [e.name for e in storage.entries(self.path) if e.name.startswith("pointer-")]

    def _lines(self, name: str) -> dict[int, str]:
        return dict((int(b), f) for b, f in (line.split("\t") for line in storage.read_text(f"{self.path}/{name}").splitlines()))

    def _pointer(self) -> dict[int, str]:
        names = self._pointers()
        return self._lines(names[-1]) if names else {}

    def read(self) -> DataFrame:
        folders = sorted(self._pointer().values())
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Insert or replace by id; of an id in both, the greater ``order`` counts, so a batch applied twice changes nothing."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        new = latest(batch.select(*[f.split()[0] for f in self.schema.split(", ")]), "id", [self.order]).withColumn("__b", bucket).persist()
        touched = sorted(r["__b"] for r in new.select("__b").distinct().collect())  # at most `buckets`
        if not touched:
            new.unpersist()
            return
        names = self._pointers()
        current = self._lines(names[-1]) if names else {}
        old = [current[b] for b in touched if b in current]
        merged = new.drop("__b")
        if old:
            merged = latest(self.spark.read.schema(self.schema).parquet(*old).unionByName(merged), "id", [self.order])
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
        current.update({b: f"{folder}/bucket={b}" for b in touched})
        number = int(names[-1].split("-")[1]) + 1 if names else 1
        fresh = f"{self.path}/next-{uuid.uuid4().hex}"
        storage.write_text(fresh, "\n".join(f"{b}\t{f}" for b, f in sorted(current.items())))
        if not storage.rename(fresh, f"{self.path}/pointer-{number:012d}"):
            raise RuntimeError(f"another writer has made version {number} of {self.path}")
        new.unpersist()
        self._clean()

    def _clean(self) -> None:
        names = self._pointers()
        used = {f.rsplit("/", 2)[1] for n in names[-self.keep :] for f in self._lines(n).values()}
        for n in names[: -self.keep]:
            storage.delete(f"{self.path}/{n}")
        for e in storage.entries(self.path):
            if e.name.startswith("v-") and e.name not in used:
                storage.delete(f"{self.path}/{e.name}")


def stream_upserts(records: DataFrame, index: VersionedIndex, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of a stream of records to the index, once everything available is read."""
    return records.writeStream.foreachBatch(lambda df, i: index.apply(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
