"""Keys of loaded tables as stored digests, so that a later load is checked without reading the tables again.

Per table and key one folder of 16-byte digests, one subfolder per load; a repeated load replaces its own subfolder. All
checks reduce the load to one row per key before they join, so a hot key is one row there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_digest(columns: list[Column]) -> Column:
    """128 bits of SHA-256 over the values as text, each with its length, so integers of any width agree; null if one is null."""
    texts = [c.cast("string") for c in columns]
    return F.substring(F.unhex(F.sha2(F.concat(*[F.concat(F.length(t), F.lit(":"), t) for t in texts]), 256)), 1, 16)


def _cols(names: list[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


@dataclass
class KeyStore:
    """Key digests below `path`; `load` names the load that is being added."""

    spark: SparkSession
    path: str
    load: str

    def _folder(self, table: str, columns: list[str]) -> str:
        return f"{self.path.rstrip('/')}/" + re.sub(r"[^A-Za-z0-9_.-]", "_", "-".join([table.lower(), *columns]).lower())

    def _loads(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [str(s.getPath().toString()) for s in fs.listStatus(path) if s.isDirectory()]
        return [p for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]

    def known(self, table: str, columns: list[str], earlier: bool = False) -> DataFrame:
        """Digests of all complete loads, or of all but this one."""
        loads = self._loads(self._folder(table, columns))
        loads = [p for p in loads if not earlier or not p.endswith(f"/load-{self.load}")]
        if not loads:
            return self.spark.createDataFrame([], "digest binary")
        return self.spark.read.schema("digest binary").parquet(*loads)

    def add(self, table: str, columns: list[str], rows: DataFrame) -> None:
        """Keep this load's keys; a second call replaces the first."""
        digests = rows.select(key_digest(_cols(columns)).alias("digest")).dropna().distinct()
        digests.write.mode("overwrite").parquet(f"{self._folder(table, columns)}/load-{self.load}")

    def repeated(self, table: str, columns: list[str], rows: DataFrame) -> DataFrame:
        """Keys of this load that occur more than once in it, or that an earlier load holds (`loaded_before`)."""
        keys = rows.select(*_cols(columns)).dropna().groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("n_rows"))
        keys = keys.withColumn("digest", key_digest(_cols(columns)))
        seen = self.known(table, columns, earlier=True).distinct().withColumn("loaded_before", F.lit(True))
        found = keys.join(seen, "digest", "left").drop("digest")
        found = found.withColumn("loaded_before", F.coalesce("loaded_before", F.lit(False)))
        return found.where((F.col("n_rows") > 1) | F.col("loaded_before"))

    def orphans(self, rows: DataFrame, columns: list[str], parent: str, parent_columns: list[str]) -> DataFrame:
        """Keys of this load that no load of the parent holds, with how many rows carry each."""
        keys = rows.select(*_cols(columns)).dropna().groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("n_rows"))
        keys = keys.withColumn("digest", key_digest(_cols(columns)))
        return keys.join(self.known(parent, parent_columns).distinct(), "digest", "left_anti").drop("digest")
