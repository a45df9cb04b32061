"""A table of embeddings that outlives a run: looked up by join, with a lifetime and a largest size."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import cache_key
from quernstone.functions.vectors import EMBEDDERS

SCHEMA = "embedder string, key string, text string, embedding array<float>, created_at timestamp, used_at timestamp"


class EmbeddingCache:
    """Embeddings by embedder and key (length and digest of the text) under ``path``, a folder that all executors reach.

    Each generation of the table is a folder of its own, written before the last is left, so a failed run costs nothing.
    A new object goes on from the last generation that was written whole.
    """

    def __init__(self, spark: SparkSession, path: str, max_size: int = 1000, ttl_seconds: int = 3600):
        self.spark, self.path, self.max_size, self.ttl = spark, path.rstrip("/"), max_size, ttl_seconds
        self.generation = self._last()
        self.hits = self.misses = 0

    def _folder(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _last(self) -> int:
        """The last generation with a mark of success; 0 if none."""
        where, files = self._folder(self.path)
        names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        done = [int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and files.exists(self._folder(f"{self.path}/{n}/_SUCCESS")[0])]
        return max(done, default=0)

    def _at(self) -> str:
        return f"{self.path}/g{self.generation}"

    def table(self, now: datetime | None = None) -> DataFrame:
        """What hasn't expired."""
        if not self.generation:
            return self.spark.createDataFrame([], SCHEMA)
        age = F.lit(now or datetime.now(timezone.utc)).cast("timestamp").cast("double") - F.col("created_at").cast("double")
        return self.spark.read.schema(SCHEMA).parquet(self._at()).filter(age <= self.ttl)

    def embed(self, df: DataFrame, text: str, embedder: str = "features", now: datetime | None = None) -> DataFrame:
        """``df`` with embedding; distinct texts that aren't in the table are embedded and stored."""
        at = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
        asked = df.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct().withColumn("key", cache_key(F.col("text"))).withColumn("embedder", F.lit(embedder))
        known = self.table(now)
        found = asked.join(known.select("embedder", "key", "text", "embedding", "created_at"), ["embedder", "key", "text"], "left").withColumn("hit", F.col("embedding").isNotNull())
        made = found.withColumn("embedding", F.when(F.col("hit"), F.col("embedding")).otherwise(EMBEDDERS[embedder](F.col("text")).cast("array<float>")))
        fresh = made.select("embedder", "key", "text", "embedding", F.coalesce("created_at", at).alias("created_at"), at.alias("used_at"), "hit")
        rest = known.join(asked.select("embedder", "key", "text"), ["embedder", "key", "text"], "left_anti").withColumn("hit", F.lit(None).cast("boolean"))
        every = fresh.unionByName(rest)
        self.generation += 1
        every.write.mode("overwrite").parquet(f"{self._at()}-all")
        every = self.spark.read.parquet(f"{self._at()}-all")
        # the newest max_size rows: TakeOrdered keeps max_size rows of each task at most
        every.orderBy(F.desc("used_at"), "key").limit(self.max_size).drop("hit").write.mode("overwrite").parquet(self._at())
        counts = every.agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("m")).first()
        self.hits, self.misses = self.hits + counts["h"], self.misses + counts["m"]
        vectors = every.filter("hit IS NOT NULL").select(F.col("text").alias("_q_text"), "embedding")
        return df.join(vectors, F.col(text) == F.col("_q_text"), "left").drop("_q_text")

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"size": self.table().count(), "max_size": self.max_size, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / total if total else 0.0}

    def clear(self) -> None:
        """Removes all generations and counts anew."""
        where, files = self._folder(self.path)
        files.delete(where, True)
        self.generation, self.hits, self.misses = 0, 0, 0
