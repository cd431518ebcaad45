"""The store: four tables under one folder, in hash buckets of their keys; a write touches only the buckets of its rows.

A manifest lists the folder of every bucket of every table. A write puts new folders beside those being read and then commits one new
manifest for all tables it changed, so a query that reads the old one ends undisturbed, a failed write changes nothing, and a
delete that concerns several tables is seen in all of them or in none. Folders that the last two manifests don't name are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schema
from factweave.operators.dedupe import best_by, upsert

TABLES = {"filings": (schema.FILING, ["doc_id"]), "facts": (schema.FACT, ["fact_id"]), "relations": (schema.RELATION, ["left_id", "right_id"]), "extractions": (schema.EXTRACTION, ["cache_key"])}
Manifest = dict[str, dict[str, str]]


class Store:
    """Reads, upserts and deletes; the folder may be any that Spark's file systems reach. ``buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ---- manifests

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        make, fs = self._fs()
        if not fs.exists(make(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(make(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, Manifest]:
        """(version, table -> bucket -> folder): the last manifest, or one of those kept."""
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return 0, {}
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifest-{version}.json").first()[0]
        return version, json.loads(text)

    def _commit(self, version: int, tables: Manifest) -> None:
        """Makes manifest ``version``; raises if another writer has made it meanwhile."""
        make, fs = self._fs()
        fresh, last = make(f"{self.root}/.manifest-{version}.new"), make(f"{self.root}/manifest-{version}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if fs.exists(last) or not fs.rename(fresh, last):
            raise RuntimeError("the store was changed by another writer")
        kept = {p for v in (version, version - 1) if v in self._versions() for t in self._manifest(v)[1].values() for p in t.values()}
        for old in [v for v in self._versions() if v < version - 1]:
            for folder in {p for t in self._manifest(old)[1].values() for p in t.values()} - kept:
                fs.delete(make(f"{self.root}/{folder}"), True)
            fs.delete(make(f"{self.root}/manifest-{old}.json"), False)

    # ---- buckets

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table][1]), F.lit(self.buckets)).cast("int")

    def _touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of rows, of which there are ``buckets`` at most."""
        return sorted(r["b"] for r in rows.select(self._bucket(table).alias("b")).distinct().collect())

    def _read(self, table: str, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        folders = manifest.get(table, {})
        paths = [f"{self.root}/{p}" for b, p in folders.items() if buckets is None or int(b) in buckets]
        ddl = TABLES[table][0]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def _stage(self, table: str, rows: DataFrame, version: int, manifest: Manifest, touched: list[int] | None = None) -> None:
        """Writes the rows of the touched buckets (all, if none are named) and puts them into the manifest."""
        shape = self.spark.createDataFrame([], TABLES[table][0]).schema
        have, folder = set(rows.columns), f"{table}/d{version}"
        typed = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
        typed.withColumn("__bucket", self._bucket(table)).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        make, fs = self._fs()
        made = {n[9:]: f"{folder}/{n}" for s in fs.listStatus(make(f"{self.root}/{folder}")) if (n := s.getPath().getName()).startswith("__bucket=")}
        stay = {} if touched is None else {b: p for b, p in manifest.get(table, {}).items() if int(b) not in touched}
        manifest[table] = stay | made

    # ---- what users call

    def read(self, table: str) -> DataFrame:
        return self._read(table, self._manifest()[1])

    def replace(self, table: str, rows: DataFrame) -> None:
        version, manifest = self._manifest()
        self._stage(table, rows, version + 1, manifest)
        self._commit(version + 1, manifest)

    def save(self, table: str, rows: DataFrame, *order: str) -> None:
        """Upserts rows by the table's key; of several new rows with a key the greatest by ``order`` stays."""
        _, keys = TABLES[table]
        new = best_by(rows, keys, *(order or [c for c, t in rows.dtypes if not t.startswith(("map", "array", "struct"))]))
        version, manifest = self._manifest()
        touched = self._touched(table, new)
        if touched:
            self._stage(table, upsert(self._read(table, manifest, touched), new, keys), version + 1, manifest, touched)
            self._commit(version + 1, manifest)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Deletes the rows with the given keys."""
        version, manifest = self._manifest()
        held = self._read(table, manifest)
        gone = keys.join(held.select(TABLES[table][1]), TABLES[table][1], "left_semi").distinct()
        touched = self._touched(table, gone)
        if touched:
            self._stage(table, self._read(table, manifest, touched).join(gone, TABLES[table][1], "left_anti"), version + 1, manifest, touched)
            self._commit(version + 1, manifest)

    def clear(self, table: str) -> None:
        version, manifest = self._manifest()
        self._commit(version + 1, manifest | {table: {}})

    def has(self, table: str, **key) -> bool:
        return not self.get(table, **key).isEmpty()

    def get(self, table: str, **key) -> DataFrame:
        df = self.read(table)
        for k, v in key.items():
            df = df.where(F.col(k) == v)
        return df.limit(1)

    def delete_document(self, doc_id: str) -> bool:
        """Deletes a document, its facts and the relations that touch one of them on either side, in one commit."""
        version, manifest = self._manifest()
        filings, facts, relations = (self._read(t, manifest) for t in ("filings", "facts", "relations"))
        if filings.where(F.col("doc_id") == doc_id).isEmpty():
            return False
        gone = facts.where(F.col("doc_id") == doc_id).select("fact_id").distinct()
        either = relations.join(gone.withColumnRenamed("fact_id", "left_id"), "left_id", "left_semi").select("left_id", "right_id")
        either = either.unionByName(relations.join(gone.withColumnRenamed("fact_id", "right_id"), "right_id", "left_semi").select("left_id", "right_id")).distinct()
        for table, keys in (("relations", either), ("facts", gone), ("filings", filings.where(F.col("doc_id") == doc_id).select("doc_id"))):
            touched = self._touched(table, keys)
            if touched:
                kept = self._read(table, manifest, touched).join(keys, TABLES[table][1], "left_anti")
                self._stage(table, kept, version + 1, manifest, touched)
        self._commit(version + 1, manifest)
        return True
