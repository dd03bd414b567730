"""A merged table of answers that takes new answers in place.

The table has one row per item with the last answer of every variant and its order, and is dealt to buckets by a hash of
the id. New answers rewrite the buckets that they touch and no others: each such bucket gets a new version next
to the old one, and a log says which version is current. The log is written last, so a job that is cut off leaves the
table as it was, and giving the same answers again changes nothing, as the highest order wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.schemas import Variant

ITEM_COLUMNS = ("item_id", "truth", "keyword", "text_length")
LOG = "bucket int, version long, folder string"


class MergedAnswers:
    """Answers under ``path``, in ``buckets`` buckets by ``item_columns[0]``.

    ``item_columns`` are properties of the item; those of the latest answer are kept. ``value`` is the answer, a number, and
    ``order`` tells later answers from earlier ones; it must be unique for an item and variant.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        variants: Sequence[Variant],
        buckets: int,
        item_columns: T.StructType,
        value: str = "pred",
        order: str = "ingest_seq",
    ):
        self.spark, self.path, self.variants, self.buckets = spark, path.rstrip("/"), list(variants), buckets
        self.items, self.value, self.order = item_columns, value, order
        self.key = item_columns.names[0]
        schema = T.StructType([*item_columns.fields, T.StructField("item_order", T.LongType())])
        for v in self.variants:
            schema = schema.add(v.name, T.IntegerType()).add(f"{v.name}_order", T.LongType())
        self.schema = schema
        self._check_settings()

    def _check_settings(self) -> None:
        """The first use writes down what the table is; another use must agree."""
        own = json.dumps([self.buckets, self.schema.json()])
        at = f"{self.path}/settings"
        if not self._there(at):
            self.spark.createDataFrame([(own,)], "settings string").coalesce(1).write.parquet(at)
        elif self.spark.read.parquet(at).first()[0] != own:
            raise ValueError(f"{self.path} has other variants, columns or buckets")

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return place.getFileSystem(conf).exists(place)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def current(self) -> dict[int, tuple[int, str]]:
        """Version and folder of every bucket that has rows; as many as there are buckets."""
        if not self._there(f"{self.path}/log"):
            return {}
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        last = log.groupBy("bucket").agg(F.max(F.struct("version", "folder")).alias("last"))
        return {r["bucket"]: (r["last"]["version"], r["last"]["folder"]) for r in last.collect()}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """One row per item with the last answer of every variant, null where a variant has none."""
        folders = [folder for _, folder in self.current().values()]
        return self._read(folders).select(*self.items.names, *[v.name for v in self.variants])

    def touched(self, answers: DataFrame) -> list[int]:
        """The buckets of new answers; at most all of them."""
        return sorted(r[0] for r in answers.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def existing(self, buckets: Sequence[int]) -> DataFrame:
        """The rows of some buckets, read from their current folders alone."""
        current = self.current()
        return self._read([current[b][1] for b in buckets if b in current])

    def upsert(self, answers: DataFrame) -> list[int]:
        """Merge long ``answers`` (item columns, ``definition``, ``model``, value and order); return the touched buckets.

        The new answers are aggregated to one row per item first, then merged with the rows of the touched buckets by a
        second aggregation of the same kind. Answers of other variants, and without an order, are left out.
        """
        mine = [(F.col("definition") == v.definition) & (F.col("model") == v.model) for v in self.variants]
        known = mine[0]
        for m in mine[1:]:
            known = known | m
        answers = answers.where(known & F.col(self.order).isNotNull() & F.col(self.key).isNotNull())
        buckets = self.touched(answers)
        if not buckets:
            return []
        new = answers.groupBy(self.key).agg(
            *[F.max_by(c, self.order).alias(c) for c in self.items.names[1:]],
            F.max(self.order).alias("item_order"),
            *[
                a
                for m, v in zip(mine, self.variants)
                for a in (
                    F.max_by(self.value, F.when(m, F.col(self.order))).alias(v.name),
                    F.max(F.when(m, F.col(self.order))).alias(f"{v.name}_order"),
                )
            ],
        )
        both = self.existing(buckets).unionByName(new)
        merged = both.groupBy(self.key).agg(
            *[F.max_by(c, "item_order").alias(c) for c in self.items.names[1:]],
            F.max("item_order").alias("item_order"),
            *[
                a
                for v in self.variants
                for a in (
                    F.max_by(v.name, f"{v.name}_order").alias(v.name),
                    F.max(f"{v.name}_order").alias(f"{v.name}_order"),
                )
            ],
        )
        current = self.current()
        version = max((v for v, _ in current.values()), default=0) + 1
        # A folder of its own for each attempt: nothing that is current is ever written to.
        root = f"{self.path}/data/version={version}-{uuid.uuid4().hex}"
        rows = merged.select(*self.schema.names).withColumn("bucket", self.bucket_of(F.col(self.key)))
        # A bucket is written by one task, or by several if adaptive execution splits it.
        rows.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(root)
        log = [(b, version, f"{root}/bucket={b}") for b in buckets]
        self.spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return buckets
