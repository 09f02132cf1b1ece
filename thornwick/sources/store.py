"""A result store on paths: results and their flat metadata by key, job events appended."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwick.operators.relations import keep_first

BUCKETS = 64
ATTEMPTS = 20


class Store:
    """Tables below root. A table of keyed rows lies in hash buckets of its key; its versions are small files that name, for
    each bucket, the folder which holds it. An upsert reads the buckets that its keys fall into, writes them anew into a
    folder of its own attempt and then publishes the next version; what a crashed write left is named by no version, so it
    is never read and never in the way. Of two writers at once the one that publishes later starts again from the other's
    version (publishing is a rename that fails where the name is taken). A read is one scan of at most as many folders as
    there are buckets, however many upserts came before.

    Rows of a null key have a bucket too and replace one another. Rows of an upsert that are equal in key all stay; a key
    that comes without rows keeps what it had. The number of buckets is fixed by a table's first version."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- versions ---------------------------------------------------------------------------------------------------

    def _path(self, name: str) -> tuple[object, object]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _version(self, name: str) -> tuple[int, dict]:
        """The last version's number and content (0 and no buckets before the first)."""
        fs, path = self._path(f"{name}/versions")
        if not fs.exists(path):
            return 0, {"buckets": self.buckets, "folders": {}, "key": None}
        found = max((s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")), default=None)
        if found is None:
            return 0, {"buckets": self.buckets, "folders": {}, "key": None}
        return int(found[1:]), self._content(name, found)

    def _content(self, name: str, version: str) -> dict:
        fs, path = self._path(f"{name}/versions/{version}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, number: int, content: dict) -> bool:
        """Makes content the version of that number; False where another writer was first."""
        jvm = self.spark.sparkContext._jvm
        fs, made = self._path(f"{name}/versions/.{uuid.uuid4().hex}")
        _, path = self._path(f"{name}/versions/v{number:012d}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        if fs.exists(path):
            fs.delete(made, False)
            return False
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(made), fs.makeQualified(path), options)
        except Exception:
            if not fs.exists(path):
                raise
            fs.delete(made, False)
            return False
        return True

    # --- rows -------------------------------------------------------------------------------------------------------

    def _scan(self, name: str, version: dict, buckets: set[int] | None = None) -> DataFrame | None:
        folders = sorted(f"{self.root}/{name}/rows/{folder}/__bucket={b}" for b, folder in version["folders"].items() if buckets is None or int(b) in buckets)
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def read(self, name: str) -> DataFrame | None:
        """All rows that count; None before the first upsert."""
        return self._scan(name, self._version(name)[1])

    def lookup(self, name: str, keys: DataFrame, key: str = "slug") -> DataFrame | None:
        """Rows whose key is in keys; only the buckets of those keys are read."""
        version = self._version(name)[1]
        buckets = self._touched(keys, key, version["buckets"])
        rows = self._scan(name, version, buckets)
        wanted = keys.select(F.col(key).alias("__key")).distinct()
        return rows if rows is None else rows.join(wanted, F.col(key).eqNullSafe(F.col("__key")), "left_semi")

    def _touched(self, rows: DataFrame, key: str, buckets: int) -> set[int]:
        """At most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.bucket(F.col(key), buckets)).distinct().collect()}

    def upsert(self, name: str, rows: DataFrame, key: str = "slug") -> None:
        """Rows replace those of the same key; only the buckets of those keys are written."""
        staged = f"{self.root}/{name}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)  # computed once, and not again where another writer was first
        new = self.spark.read.schema(rows.schema).parquet(staged)
        for _ in range(ATTEMPTS):
            number, version = self._version(name)
            if version["key"] not in (None, key):
                raise ValueError(f"{name} is kept by {version['key']}, not by {key}")
            buckets = self._touched(new, key, version["buckets"])
            folder = uuid.uuid4().hex
            if buckets:
                old = self._scan(name, version, buckets)
                whole = new
                if old is not None:
                    keys = new.select(F.col(key).alias("__key")).distinct()
                    whole = old.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti").unionByName(new, allowMissingColumns=True)
                whole = whole.withColumn("__bucket", self.bucket(F.col(key), version["buckets"]))
                # tasks of a fair size: a large bucket is split, small ones share a task
                whole.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{name}/rows/{folder}")
            elif number:
                break
            content = {"buckets": version["buckets"], "key": key, "folders": version["folders"] | {str(b): folder for b in buckets}}
            if self._publish(name, number + 1, content):
                break
        else:
            raise RuntimeError(f"{name}: other writers were first {ATTEMPTS} times")
        fs, path = self._path(f"{name}/staged/{staged.rsplit('/', 1)[1]}")
        fs.delete(path, True)

    def put_results(self, results: DataFrame) -> None:
        """Stores results by slug, and their metadata beside them."""
        from thornwick.operators.catalog import meta

        self.upsert("results", results)
        self.upsert("metas", meta(results))

    def compact(self, name: str, keep: int = 1) -> None:
        """Deletes versions but the last ones, and folders that none of those names. Only while nobody writes or reads."""
        fs, path = self._path(f"{name}/versions")
        if not fs.exists(path):
            return
        found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))
        named = set()
        for v in found[-keep:]:
            named |= set(self._content(name, v)["folders"].values())
        for v in found[:-keep]:
            fs.delete(self._path(f"{name}/versions/{v}")[1], False)
        rows = self._path(f"{name}/rows")[1]
        for s in fs.listStatus(rows) if fs.exists(rows) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def events(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def slugs(self, name: str) -> DataFrame:
        found = self.read(name)
        return found.select("slug").distinct() if found is not None else self.spark.createDataFrame([], "slug string")

    def jobs(self) -> DataFrame:
        """Each job's last event."""
        return keep_first(self.events("jobs"), [F.col("job_id")], [F.desc("seq")])


def single_map(spark: SparkSession, path: str, result: str) -> DataFrame:
    """Results of the older form, one JSON document {"results": {name: result}}: name and the result's fields (DDL)."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<results:map<string,{result}>>")["results"].alias("m"))
    return rows.select(F.explode("m").alias("name", "result")).select("name", "result.*")
