"""Tables that stand for keyed stores: chunks, caches, sessions, requests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X

#: Schemas of the store (S13, S14). The full-text table is millrace.operators.retrieval.inverted_index().
CHUNKS = (
    "id long, file_path string, start_line int, end_line int, content string, content_hash string, embedding array<float>, provider string, model string, updated_at timestamp, source string"
)
VECTOR_CACHE = "content_hash string, embedding array<float>, provider string, model string, created_at timestamp"
META = "key string, value string"
SESSIONS = "session_key string, created_at long, updated_at long, last_channel string, last_to string, last_account_id string, last_agent_id string"


#: A run is merged with the one before it unless that is so many times larger.
SIZE_RATIO = 4
BUCKETS = 16


class TableStore:
    """A keyed table as runs of changes.

    An upsert or a delete writes a run that holds its own rows alone: sorted by key in buckets of a hash of the key, deleted keys as tombstones.
    A reader takes the runs together, the newest row of a key wins. Runs are merged while one is not SIZE_RATIO times larger than the one
    after it, so there are some log(table) of them and a row is rewritten that often.

    The manifest names the runs and is put in place last, by a rename: a reader sees the whole of a change or nothing, and what a crash leaves
    behind is in no manifest. One writer at a time; a manifest that is there already is not replaced. A null key is a key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS, ratio: float = SIZE_RATIO):
        self.spark, self.path, self.schema, self.key, self.buckets, self.ratio = spark, path.rstrip("/"), schema, key, buckets, ratio

    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, fs = self._place("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def runs(self, version: int | None = None) -> list[dict]:
        """Name and bytes of the runs of a version, the oldest first; of the newest version where none is given."""
        found = self.versions()
        if not found:
            return []
        place, fs = self._place("manifests", f"{found[-1] if version is None else version:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, runs: list[dict]) -> None:
        version = (self.versions() or [0])[-1] + 1
        draft, fs = self._place("manifests", f"_{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        place, _ = self._place("manifests", f"{version:012d}.json")
        if fs.exists(place) or not fs.rename(draft, place):
            raise RuntimeError(f"version {version} was written meanwhile")

    def _write_run(self, rows: DataFrame) -> dict:
        """rows: the columns of the schema, and _deleted."""
        name = f"run-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("_bucket", bucket).repartitionByRange("_bucket", self.key).sortWithinPartitions("_bucket", self.key)
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        place, fs = self._place(name)
        return {"name": name, "bytes": fs.getContentSummary(place).getLength()}

    def _read_run(self, run: dict) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _deleted boolean").parquet(f"{self.path}/{run['name']}").drop("_bucket")

    def _merged(self, runs: list[dict]) -> DataFrame:
        """The newest row of each key, tombstones among them."""
        rows = self._read_run(runs[0])
        if len(runs) == 1:
            return rows
        late = None
        for n, run in enumerate(runs[1:]):
            part = self._read_run(run).withColumn("_run", F.lit(n))
            late = part if late is None else late.unionByName(part)
        columns = [c for c in late.columns if c != "_run"]
        late = late.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*columns), "_run").alias("_row")).select("_row.*")
        # What is new is small against the first run, and only its keys meet that.
        old = rows.join(late.select(F.col(self.key).alias("_key")), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        return old.unionByName(late)

    def read(self, version: int | None = None) -> DataFrame:
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(runs).where("NOT _deleted").drop("_deleted")

    def write(self, df: DataFrame) -> None:
        """df in place of the whole table; its keys are unique."""
        columns = self.spark.createDataFrame([], self.schema).columns
        self._publish([self._write_run(df.select(*columns).withColumn("_deleted", F.lit(False)))])

    def _append(self, rows: DataFrame) -> None:
        runs = [*self.runs(), self._write_run(rows)]
        self._publish(runs)
        self.compact()

    def upsert(self, new: DataFrame) -> None:
        """Rows of new replace those with their key; of new rows with one key the greatest by all columns stays. Columns that new lacks are null."""
        from millrace.operators.retrieval import latest_wins

        empty = self.spark.createDataFrame([], self.schema)
        self._append(latest_wins(empty, new, self.key).select(*empty.columns).withColumn("_deleted", F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        """Rows whose key is among keys go."""
        rows = keys.select(self.key).distinct()
        for f in self.spark.createDataFrame([], self.schema).schema:
            if f.name != self.key:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        self._append(rows.withColumn("_deleted", F.lit(True)))

    def compact(self, whole: bool = False) -> None:
        """Merges runs of like size, or all of them; a version of its own."""
        runs = before = self.runs()
        while len(runs) > 1 and (whole or runs[-2]["bytes"] < self.ratio * runs[-1]["bytes"]):
            first = 0 if whole else len(runs) - 2
            if not whole:
                # All that would be merged one after the other are merged at once.
                size = runs[-1]["bytes"] + runs[-2]["bytes"]
                while first and runs[first - 1]["bytes"] < self.ratio * size:
                    first -= 1
                    size += runs[first]["bytes"]
            rows = self._merged(runs[first:])
            # Below the oldest run there is nothing that a tombstone could hide.
            runs = [*runs[:first], self._write_run(rows if first else rows.where("NOT _deleted"))]
        if runs != before:
            self._publish(runs)

    def vacuum(self, versions: int = 1) -> int:
        """Removes the runs that the newest versions do not name, and older manifests; returns how many runs went."""
        found = self.versions()
        kept = {r["name"] for v in found[-versions:] for r in self.runs(v)}
        place, fs = self._place()
        gone = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("run-") and s.getPath().getName() not in kept]
        for old in found[:-versions]:
            fs.delete(self._place("manifests", f"{old:012d}.json")[0], False)
        for run in gone:
            fs.delete(run, True)
        return len(gone)

    def clear_vectors(self) -> None:
        """All embeddings null."""
        df = self.read()
        self.write(df.withColumn("embedding", F.lit(None).cast(df.schema["embedding"].dataType)))


def cached_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached vector of their content."""
    return chunks.drop("embedding").join(cache.select("content_hash", "embedding"), "content_hash", "left")


def fresh(cache: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Entries that are well formed and not older than their time to live."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("cached_at").cast("timestamp"))
    return cache.where(F.col("endpoint").isNotNull() & F.col("url").isNotNull() & F.col("data").rlike(r"^\s*[\[{]") & (age <= ttl_s))


def latest_entries(cache: DataFrame, most: int = 100) -> DataFrame:
    """The newest entries of a bounded cache, keys whatever their case (S26); of one time, the greatest by the other columns."""
    from pyspark.sql import Window

    key = F.lower("key")
    last = cache.withColumn("key", key).withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cached_at"), *(F.desc(c) for c in cache.columns if c not in ("cached_at", "key"))))).where("_rn = 1").drop("_rn")
    return last.orderBy(F.desc("cached_at"), "key").limit(most)


def request_keys(requests: DataFrame) -> DataFrame:
    """Requests (endpoint, params) with the file name of their cache entry."""
    return requests.withColumn("cache_key", X.cache_key(F.col("endpoint"), F.col("params")))
