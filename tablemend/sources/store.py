"""A store of rows that are numbered as they arrive, paged by number and found by key.

Below ``path`` every batch owns one folder of each table, so a batch that is run again overwrites itself:

* ``rows/batch_id=N/segment=K``: the rows with their number ``id``, at most ``segment_rows`` to a segment, sorted by it
* ``keys/batch_id=N/bucket=B``: key and number only, dealt by a hash of the key, sorted by key
* ``spans/batch_id=N``: smallest and largest key of each bucket
* ``fences/batch_id=N``: numbers and row count of each segment; written last, it makes the batch visible

Batches come in ascending order and one writer works at a time, as ``foreachBatch`` does it. Numbers start
at 1, rise in the order of arrival and are never given twice, also after deletes.

Defined cases: rows with a NULL key are stored and never count as known; equal keys inside one batch are all
kept, as in the batch form; an empty batch leaves an empty folder; a store that does not exist reads as empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from ..session import cut, drop_table
from ..streaming.sinks import read_batches, write_batch

FENCE_SCHEMA = "segment long, first_id long, last_id long, n long"


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` is the DDL of the stored columns without ``id``; ``buckets`` must stay the same for a path."""

    path: str
    schema: str
    key: str = "shipment_id"
    buckets: int = 64
    segment_rows: int = 1 << 20

    # --- reading -------------------------------------------------------------

    def fences(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """One row per segment of the finished batches."""
        return read_batches(spark, f"{self.path}/fences", FENCE_SCHEMA, before)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of finished batches, with ``id, batch_id, segment``."""
        last = self.fences(spark).agg(F.max("batch_id")).first()[0]
        stored = read_batches(spark, f"{self.path}/rows", f"id long, {self.schema}, segment long")
        return stored.filter(F.col("batch_id") <= F.lit(-1 if last is None else last))

    def keys(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return read_batches(spark, f"{self.path}/keys", f"{self._key_field(spark)}, id long, bucket long", before)

    def total(self, spark: SparkSession) -> DataFrame:
        """Row count, from the fences alone."""
        return self.fences(spark).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def known(self, incoming: DataFrame, before: int | None = None) -> DataFrame:
        """Distinct keys of ``incoming`` that are stored.

        Only the key index is read, of it only the buckets that the batch has keys in and the batches whose
        span of keys in such a bucket meets that of the incoming keys; both are partition filters.
        """
        near = self._near(incoming, before)
        if near is None:
            return incoming.select(self.key).limit(0)
        return self._asked(near, incoming)

    def _asked(self, near: DataFrame, incoming: DataFrame) -> DataFrame:
        asked = incoming.filter(F.col(self.key).isNotNull()).select(self.key).distinct()
        return near.join(asked, self.key, "left_semi").distinct()

    def _near(self, incoming: DataFrame, before: int | None = None) -> DataFrame | None:
        """Stored keys of the buckets and batches that may hold keys of ``incoming``; they may repeat. None if there are none."""
        spark, key = incoming.sparkSession, F.col(self.key)
        # at most one row per bucket; keys are folded where they lie
        reach = (
            incoming.filter(key.isNotNull())
            .groupBy(self._bucket().alias("bucket"))
            .agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"))
        )
        spans = read_batches(spark, f"{self.path}/spans", self._span_schema(spark), before)
        hit = spans.join(F.broadcast(reach), "bucket").filter("first_key <= high AND last_key >= low")
        # folder names only: as many as there are buckets and batches, however many rows they hold
        found = hit.agg(F.collect_set("bucket"), F.collect_set("batch_id")).first()
        if not found[0]:
            return None
        near = self.keys(spark, before).filter(F.col("bucket").isin(found[0]) & F.col("batch_id").isin(found[1]))
        return near.select(self.key)

    def _unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows of a batch whose key is not stored.

        A store that is larger than the batch is first reduced to the batch's keys; a smaller one is met as it is, so that
        the keys of the batch are not shuffled apart from its rows.
        """
        near = self._near(batch, batch_id)
        if near is None:
            return batch
        stored = self.fences(batch.sparkSession, before=batch_id).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        known = self._asked(near, batch) if stored > batch.count() else near
        return batch.join(known, self.key, "left_anti")

    def lookup(self, spark: SparkSession, value) -> DataFrame:
        """The row of a key, of several copies the one with the lowest number: one bucket, then one segment."""
        bucket = spark.range(1).select(F.lit(value).alias(self.key)).select(self._bucket()).first()[0]
        entries = self.keys(spark).filter((F.col("bucket") == bucket) & (F.col(self.key) == F.lit(value)))
        return self.by_id(spark, entries.agg(F.min("id")).first()[0])

    def by_id(self, spark: SparkSession, row_id: int | None) -> DataFrame:
        """The row of a number; empty if there is none."""
        place = self._segment_of(spark, row_id)
        rows = self.rows(spark).filter(F.col("id") == F.lit(row_id))
        return rows.filter(self._in_segment(place)) if place else rows.limit(0)

    def page(self, spark: SparkSession, page: int = 1, limit: int = 50, where: Column | None = None) -> DataFrame:
        """One page, newest number first; ``where`` narrows the rows first.

        Row counts per segment say which segments hold the page: the fences, or with ``where`` one counting
        pass. Only those are read, and from segments without gaps only the numbers of the page.
        """
        page, limit = max(1, int(page)), min(200, max(1, int(limit)))
        skip = (page - 1) * limit
        fences = self.fences(spark)
        if where is not None:
            counted = self.rows(spark).filter(where).groupBy("batch_id", "segment").agg(F.count("*").alias("n"))
            bounds = fences.select("batch_id", "segment", "first_id", "last_id")
            fences = bounds.join(counted, ["batch_id", "segment"])
        newer = Window.orderBy(F.col("last_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
        # one row per segment; segments with rows on the page are at most as many as its rows
        ahead = fences.filter("n > 0").withColumn("ahead", F.coalesce(F.sum("n").over(newer), F.lit(0)))
        here = ahead.filter((F.col("ahead") < skip + limit) & (F.col("ahead") + F.col("n") > skip)).collect()
        rows = self.rows(spark)
        if not here:
            return rows.limit(0)
        wanted, before = F.lit(False), F.lit(None).cast("long")
        for seg in here:
            at = self._in_segment(seg)
            top, span = seg["last_id"], F.lit(True)
            start = seg["ahead"]
            if where is None and seg["n"] == seg["last_id"] - seg["first_id"] + 1:
                start = max(start, skip)
                top -= start - seg["ahead"]
                span = F.col("id").between(top - (skip + limit - start) + 1, top)
            wanted = wanted | (at & span)
            before = F.when(at, F.lit(start)).otherwise(before)
        chosen = rows.filter(wanted) if where is None else rows.filter(wanted).filter(where)
        nth = F.row_number().over(Window.partitionBy("batch_id", "segment").orderBy(F.col("id").desc()))
        placed = chosen.withColumn("place", nth + before)
        return placed.filter(F.col("place").between(skip + 1, skip + limit)).drop("place").orderBy(F.col("id").desc())

    # --- writing -------------------------------------------------------------

    def append(self, incoming: DataFrame, batch_id: int, order: Sequence[str], settled: bool = False) -> None:
        """Number the rows whose key is not stored, in ``order``, and store them as one batch.

        Ranges of ``order`` are dealt by rows, so neither a hot key nor a hot file makes a large task.
        ``settled`` rows, those of a table, are the same whenever they are read, so they are not copied first.
        """
        spark = incoming.sparkSession
        columns = [f.name for f in self._fields(spark)]
        batch = incoming.select(*dict.fromkeys([*columns, *order]))
        copies = [] if settled else [cut(batch)]
        batch = batch if settled else copies[0]
        fresh = self._unseen(batch, batch_id)
        if fresh is not batch:
            # ranges are sampled before rows are dealt: without a copy the rows would be matched with the store twice
            copies.append(fresh := cut(fresh))
        # the place in a sorted range is the low 33 bits, the range the high ones; kept as written
        dealt = cut(
            fresh.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        )
        part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        dealt_parts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        # one row per task of the write above
        starts = dealt_parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        top = self.fences(spark, before=batch_id).agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]
        place = F.col("start") + nth
        numbered = dealt.withColumn("part", part).join(F.broadcast(starts), "part").select(
            (place + top + 1).alias("id"), *columns, F.floor(place / self.segment_rows).cast("long").alias("segment")
        )
        folder = f"{self.path}/rows/batch_id={batch_id}"
        numbered.sortWithinPartitions("segment", "id").write.mode("overwrite").partitionBy("segment").parquet(folder)
        # from here on numbers are read, not made again
        stored = read_batches(spark, f"{self.path}/rows", f"id long, {self.schema}, segment long")
        self._index(stored.filter(F.col("batch_id") == batch_id), batch_id)
        for copy in (dealt, *copies):
            drop_table(copy)

    def delete(self, spark: SparkSession, row_id: int) -> None:
        """Delete the row of a number: its segment and its bucket of the key index are written anew, no other file.

        The index goes first and the fence last, so a delete that was cut short is completed by repeating it.
        """
        place = self._segment_of(spark, row_id)
        if place is None:
            return
        batch_id, rows = place["batch_id"], self.rows(spark).filter(self._in_segment(place))
        gone, kept = F.col("id") == F.lit(row_id), F.col("id") != F.lit(row_id)
        bucket = rows.filter(gone).select(self._bucket()).first()
        if bucket is not None:
            index = self.keys(spark).filter((F.col("batch_id") == batch_id) & (F.col("bucket") == bucket[0]))
            self._replace(index.filter(kept), "keys", ["batch_id", "bucket"], [batch_id, bucket[0]], [self.key, "id"])
            self._replace(rows.filter(kept), "rows", ["batch_id", "segment"], [batch_id, place["segment"]], ["id"])
        left = self.rows(spark).filter(self._in_segment(place)).count()
        here = F.col("segment") == place["segment"]
        fences = self.fences(spark).filter(F.col("batch_id") == batch_id).drop("batch_id")
        told = cut(fences.withColumn("n", F.when(here, F.lit(left)).otherwise(F.col("n"))))
        write_batch(told.coalesce(1), f"{self.path}/fences", batch_id)
        drop_table(told)

    def _index(self, stored: DataFrame, batch_id: int) -> None:
        keyed = stored.select(self.key, "id", self._bucket().alias("bucket"))
        # by rows, not by bucket alone: copies of a hot key spread over tasks
        spread = keyed.repartitionByRange("bucket", self.key, "id").sortWithinPartitions("bucket", self.key, "id")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch_id={batch_id}")
        spans = keyed.groupBy("bucket").agg(F.min(self.key).alias("first_key"), F.max(self.key).alias("last_key"))
        write_batch(spans.coalesce(1), f"{self.path}/spans", batch_id)
        fences = stored.groupBy("segment").agg(
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")
        )
        write_batch(fences.coalesce(1), f"{self.path}/fences", batch_id)

    def _replace(self, kept: DataFrame, table: str, parts: list[str], values: list[int], order: list[str]) -> None:
        """One partition of a table becomes ``kept``, which is read from that very partition."""
        copy = cut(kept)
        if copy.isEmpty():
            # overwriting partitions by content would leave one without content as it was
            folder = "/".join(f"{name}={value}" for name, value in zip(parts, values))
            copy.drop(*parts).write.mode("overwrite").parquet(f"{self.path}/{table}/{folder}")
        else:
            sorted_copy = copy.coalesce(1).sortWithinPartitions(*order)
            writer = sorted_copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(*parts).parquet(f"{self.path}/{table}")
        drop_table(copy)

    # --- helpers -------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets).cast("long"))

    def _fields(self, spark: SparkSession):
        return spark.createDataFrame([], self.schema).schema.fields

    def _key_field(self, spark: SparkSession) -> str:
        kind = next(f.dataType.simpleString() for f in self._fields(spark) if f.name == self.key)
        return f"{self.key} {kind}"

    def _span_schema(self, spark: SparkSession) -> str:
        kind = self._key_field(spark).split(" ", 1)[1]
        return f"bucket long, first_key {kind}, last_key {kind}"

    def _segment_of(self, spark: SparkSession, row_id: int | None):
        inside = F.lit(row_id).cast("long").between(F.col("first_id"), F.col("last_id"))
        return self.fences(spark).filter(inside).first()

    def _in_segment(self, place) -> Column:
        return (F.col("batch_id") == place["batch_id"]) & (F.col("segment") == place["segment"])
