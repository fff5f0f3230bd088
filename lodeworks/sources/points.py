"""A collection of points (id, vector, payload) as a table in buckets, with a manifest for each version.

A change writes the buckets that it touches anew, to a place of its own, and becomes visible by one rename of its manifest. So a reader sees
all of a change or nothing, a run that dies before the rename leaves only files that nothing refers to, and of two writers that
begin from one version the second fails and can be run again. Each change has a name; one that the collection already has is not applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    dimension: int = 0
    schema: str = ""
    paths: dict[str, str] = field(default_factory=dict)
    changes: tuple[str, ...] = ()


class Points:
    """The collection in ``folder``. Rows: ``id`` (a text that is not blank), ``vector``, and columns of payload. ``buckets`` holds for the life of a
    collection: choose it so that a bucket is some hundred MB at the size to come."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, id_: str = "id", vector: str = "vector"):
        self.spark, self.folder, self.buckets, self.id, self.vector = spark, folder.rstrip("/"), buckets, id_, vector

    # -- manifests

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._place(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest | None:
        """The newest version; None where the collection does not exist."""
        folder = self._place(f"{self.folder}/manifests")
        fs = self._files(self.folder)
        if not fs.exists(folder):
            return None
        names = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("_"))
        if not names:
            return None
        stream = fs.open(self._place(f"{self.folder}/manifests/{names[-1]}"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(**told | {"changes": tuple(told["changes"])})

    def _commit(self, m: Manifest) -> None:
        """Make ``m`` the newest version, or fail where there is one of its number."""
        fs, jvm = self._files(self.folder), self.spark._jvm
        draft, final = self._place(f"{self.folder}/manifests/_{uuid.uuid4().hex}"), self._place(f"{self.folder}/manifests/{m.version:010d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": m.version, "dimension": m.dimension, "schema": m.schema, "paths": m.paths, "changes": list(m.changes)}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {m.version} was committed by another change") from e
            raise

    # -- reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.id)), F.lit(self.buckets)).cast("int")

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        paths = [f"{self.folder}/{p}" for b, p in sorted(m.paths.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema: T.StructType | str = "id string, vector array<float>") -> DataFrame:
        """All points of the newest version; one that does not exist is empty, with ``schema``."""
        m = self.manifest()
        return self._rows(m) if m else self.spark.createDataFrame([], schema)

    # -- changing

    def _checked(self, points: DataFrame, m: Manifest | None) -> int:
        """The dimension of the points' vectors; an error where one has none, holds what is no number, or has another."""
        v, id_ = F.col(self.vector), F.col(self.id).cast("string")
        n = F.size(v)
        odd = F.count_if(v.isNull() | (n <= 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x)))
        told = points.agg(odd.alias("odd"), F.count_if(id_.isNull() | (F.trim(id_) == "")).alias("blank"), F.min(n).alias("least"), F.max(n).alias("most")).first()
        if told["blank"]:
            raise ValueError(f"{told['blank']} points have a blank id")
        if told["odd"]:
            raise ValueError(f"{told['odd']} points have no vector of numbers")
        if told["least"] != told["most"] or m and m.dimension and told["most"] not in (None, m.dimension):
            raise ValueError(f"vectors have {told['least']} to {told['most']} components, the collection has {m.dimension if m else 'none'}")
        return told["most"] or 0

    def _changed(self, change: str, m: Manifest, touched: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> int:
        """Write the buckets of ``touched`` (bucket) anew and commit; returns the version."""
        held = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # self.buckets rows at most
        paths = dict(m.paths)
        if held:
            place = f"data/{uuid.uuid4().hex}"
            rows = rewrite(self._rows(m, held)).withColumn("_bucket", self._bucket())
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
            fs = self._files(self.folder)
            written = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(self._place(f"{self.folder}/{place}")) if s.isDirectory()}
            for b in map(str, held):
                paths.pop(b, None)
                if b in written:
                    paths[b] = f"{place}/_bucket={b}"
        self._commit(replace(m, version=m.version + 1, paths=paths, changes=(*m.changes, change)))
        return m.version + 1

    def upsert(self, points: DataFrame, change: str) -> int:
        """Points put in the place of those of their id, whole; makes the collection at its first change. Of several rows of one id the greatest
        stays; a column that only one side has is null on the other."""
        m = self.manifest()
        if m and change in m.changes:
            return m.version
        dimension = self._checked(points, m)
        others = [c for c in points.columns if c != self.id]
        new = points.groupBy(F.col(self.id).cast("string").alias(self.id)).agg(F.max(F.struct(*others)).alias("p")).select(self.id, *[F.col("p")[c].alias(c) for c in others])
        schema = T.StructType.fromJson(json.loads(m.schema)) if m else new.schema
        schema = T.StructType([*schema.fields, *[f for f in new.schema.fields if f.name not in schema.names]])
        m = replace(m or Manifest(), dimension=dimension or (m.dimension if m else 0), schema=schema.json())

        def put(old: DataFrame) -> DataFrame:
            both = old.join(new, self.id, "left_anti").unionByName(new, allowMissingColumns=True)
            return both.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

        return self._changed(change, m, new.select(self._bucket().alias("bucket")), put)

    def _known(self, change: str) -> tuple[Manifest | None, bool]:
        """The newest version, and whether there is nothing to do: no collection, or the change is in it."""
        m = self.manifest()
        return m, m is None or change in m.changes

    def set_payloads(self, payloads: DataFrame, change: str) -> int:
        """Columns of payload set by id, vectors untouched; ids that are not there are not added."""
        m, done = self._known(change)
        if done:
            return m.version if m else 0
        given = [c for c in payloads.columns if c != self.id]
        new = payloads.groupBy(F.col(self.id).cast("string").alias(self.id)).agg(F.max(F.struct(*given)).alias("_new"))

        def put(old: DataFrame) -> DataFrame:
            both = old.join(new, self.id, "left")
            return both.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns])

        return self._changed(change, m, new.select(self._bucket().alias("bucket")), put)

    def set_where(self, condition: Column, values: dict[str, object], change: str) -> int:
        """Columns of payload set where the condition holds; None clears them."""
        m, done = self._known(change)
        if done or not values:
            return m.version if m else 0
        hit = self._rows(m).where(condition).select(self._bucket().alias("bucket"))

        def put(old: DataFrame) -> DataFrame:
            return old.select(*[F.when(condition, F.lit(values[c]).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])

        return self._changed(change, m, hit, put)

    def delete(self, ids: DataFrame, change: str) -> int:
        """Points removed by id."""
        m, done = self._known(change)
        if done:
            return m.version if m else 0
        gone = ids.select(F.col(self.id).cast("string").alias(self.id)).distinct()
        return self._changed(change, m, gone.select(self._bucket().alias("bucket")), lambda old: old.join(gone, self.id, "left_anti"))

    def delete_where(self, condition: Column, change: str) -> int:
        """Points removed where the condition holds, as those of a document."""
        m, done = self._known(change)
        if done:
            return m.version if m else 0
        hit = self._rows(m).where(condition).select(self._bucket().alias("bucket"))
        return self._changed(change, m, hit, lambda old: old.where(~F.coalesce(condition, F.lit(False))))

    def sweep(self) -> int:
        """Delete written data that the newest version does not refer to; how many places. Not while a change or an old version's reader runs."""
        m, fs = self.manifest(), self._files(self.folder)
        if m is None:
            return 0
        used = {p.split("/")[1] for p in m.paths.values()}
        data = self._place(f"{self.folder}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used] if fs.exists(data) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
