"""A keyed store whose upserts rewrite only the buckets they touch.

Rows lie in `data/v=<version>/b=<bucket>`; a manifest names the version of each bucket. An
upsert reads the buckets of its keys, writes them anew under the next version, and only then
adds a manifest, so a job that fails leaves the last version as it was, and
earlier ones can be read until they are vacuumed. Buckets come from a hash of
the columns `by`, so what arrives together for a few entities touches few of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.operators import evidence
from sievelake.runtime import broadcast_if_small, cut


class Files:
    """The few operations on names that Spark's readers and writers don't have, in whatever store holds the path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def claim(self, path: str) -> bool:
        """Makes an empty file; False if there is one, as another writer then has the name."""
        return self._fs.createNewFile(self._path(path))

    def put(self, path: str, text: str) -> None:
        """Writes a file under another name and renames it, so that nobody reads half of it."""
        out = self._fs.create(self._path(path + ".part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(self._path(path + ".part"), self._path(path)):
            raise OSError(f"can't rename {path}.part")

    def get(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Store:
    """A store at path with unique keys. Its first upsert makes it; number of buckets and columns are kept from then on."""

    def __init__(self, spark: SparkSession, path: str, key: list[str] = evidence.KEY, by: tuple[str, ...] = ("entity",), buckets: int = 64):
        self.spark, self.path, self.key, self.by, self.buckets = spark, path.rstrip("/"), key, by, buckets
        self.files = Files(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, buckets (bucket to the version that holds it), touched (those this version wrote)."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "buckets": {}, "touched": []}
        at = found[-1] if version is None else version
        if at not in found:
            raise ValueError(f"no version {at}: {found}")
        return json.loads(self.files.get(f"{self.path}/manifests/{at:010d}.json"))

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        live = [(int(b), v) for b, v in manifest["buckets"].items() if only is None or int(b) in set(only)]
        if not live:
            return None
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        full = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("b", T.IntegerType())])
        paths = [f"{self.path}/data/v={v}/b={b}" for b, v in live]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).drop("v")

    def current(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one."""
        m = self.manifest(version)
        df = self._read(m)
        if df is not None:
            return df.drop("b")
        if m["schema"] is None:
            raise ValueError(f"no store at {self.path}")
        return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(m["schema"])))

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (columns `by` at least): only their buckets are read."""
        wanted = [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        df = self._read(self.manifest(), wanted)
        rows = self.current().limit(0) if df is None else df.drop("b")
        on = [c for c in self.key if c in keys.columns]
        k = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]).distinct()
        return rows.join(broadcast_if_small(k), [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)], "left_semi")

    def _matched(self, k: DataFrame) -> list[Column]:
        return [F.col(c).eqNullSafe(k[f"_k{i}"]) for i, c in enumerate(self.key)]

    def upsert(self, batch: DataFrame, first_seen: bool = True) -> int:
        """Merges batch (unique keys) in and returns the new version; an empty batch makes none.

        With first_seen, batch has the columns seen_at and value and the store first_seen
        too: it stays while the value stays the same, null-safely, and unknown states and FOUND without a value
        raise. Else a row of batch takes its key's place as it is. Old rows aren't shuffled where the batch's keys are few enough to be broadcast.
        """
        if first_seen:
            batch = evidence.checked(batch).withColumn("first_seen", F.col("seen_at"))
        batch = cut(batch.withColumn("b", self.bucket()))
        touched = sorted(r["b"] for r in batch.select("b").distinct().collect())
        if not touched:
            return self.manifest()["version"]
        m = self.manifest()
        schema = batch.drop("b").schema
        columns = schema.names
        if m["schema"] is not None:
            columns = T.StructType.fromJson(json.loads(m["schema"])).names
            if set(columns) != set(schema.names):
                raise ValueError(f"the store has columns {columns}, the batch {schema.names}")
        version = max([m["version"], *(int(n) for n in self.files.names(f"{self.path}/claims"))]) + 1
        if not self.files.claim(f"{self.path}/claims/{version:010d}"):
            raise RuntimeError(f"version {version} of {self.path} is being written by another job")
        old = self._read(m, touched)
        new = batch.select(*columns, "b")
        if old is not None:
            k = broadcast_if_small(batch.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)]))
            kept = old.join(k, self._matched(k), "left_anti")
            if first_seen:
                was = old.join(k, self._matched(k), "left_semi").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)], F.col("value").alias("_value"), F.col("first_seen").alias("_first"))
                was = broadcast_if_small(cut(was))
                same = F.col("_first").isNotNull() & F.col("_value").eqNullSafe(F.col("value"))
                new = new.join(was, self._matched(was), "left").withColumn("first_seen", F.when(same, F.col("_first")).otherwise(F.col("first_seen"))).select(*columns, "b")
            new = kept.select(*columns, "b").unionByName(new.repartition("b"))
        else:
            new = new.repartition("b")
        new.write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/data/v={version}")
        if self.versions() != [] and self.versions()[-1] != m["version"]:
            raise RuntimeError(f"{self.path} has changed since version {m['version']}")
        said = {"version": version, "schema": m["schema"] or json.dumps(schema.jsonValue()), "buckets": m["buckets"] | {str(b): version for b in touched}, "touched": touched}
        self.files.put(f"{self.path}/manifests/{version:010d}.json", json.dumps(said))
        return version

    def replace(self, rows: DataFrame, touched: list[int]) -> int:
        """Puts rows in the place of everything in the buckets `touched` and returns the new version; rows of other buckets are left out. Buckets that rows has nothing for become empty."""
        m = self.manifest()
        schema = rows.schema
        version = max([m["version"], *(int(n) for n in self.files.names(f"{self.path}/claims"))]) + 1
        if not self.files.claim(f"{self.path}/claims/{version:010d}"):
            raise RuntimeError(f"version {version} of {self.path} is being written by another job")
        new = rows.withColumn("b", self.bucket()).where(F.col("b").isin(touched)).repartition("b")
        new.write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/data/v={version}")
        full = {int(n[2:]) for n in self.files.names(f"{self.path}/data/v={version}") if n.startswith("b=")}
        rest = {b: v for b, v in m["buckets"].items() if int(b) not in set(touched)}
        said = {"version": version, "schema": json.dumps(schema.jsonValue()), "buckets": rest | {str(b): version for b in sorted(full)}, "touched": sorted(touched)}
        self.files.put(f"{self.path}/manifests/{version:010d}.json", json.dumps(said))
        return version

    def vacuum(self, keep: int = 2) -> list[int]:
        """Forgets all but the last `keep` versions and removes the data that only forgotten or failed ones had; returns the versions whose data went."""
        found = self.versions()
        for v in found[:-keep] if keep else []:
            self.files.remove(f"{self.path}/manifests/{v:010d}.json")
        live = {v for at in self.versions() for v in self.manifest(at)["buckets"].values()}
        gone = [int(n[2:]) for n in self.files.names(f"{self.path}/data") if n.startswith("v=") and int(n[2:]) not in live]
        for v in gone:
            self.files.remove(f"{self.path}/data/v={v}")
        return gone

    def clustered(self, name: str, version: int | None = None) -> DataFrame:
        """The rows as table `name` of the catalogue, clustered and sorted by key: tables made so, of equal number of buckets, are joined by key without a shuffle."""
        keys = [*self.by, *[c for c in self.key if c not in self.by]]
        rows = self.current(version)
        rows.repartition(self.buckets, *keys).write.mode("overwrite").bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)
        return self.spark.table(name)
