"""Stock movements posted to the ledger as they arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallyhouse.plans.stock import MOVEMENTS, post_movements
from tallyhouse.schemas import schema
from tallyhouse.sources.store import Store
from tallyhouse.tables import Tables

LEDGER = "stock_update"


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger written by ``post_stream`` with the micro-batch of each row."""
    layout = StructType([*schema(LEDGER), StructField("arrival", LongType())])
    return spark.read.schema(layout).parquet(path)


def post_stream(
    forms: DataFrame,
    opening: DataFrame,
    path: str,
    checkpoint: str,
    as_of: dt.date,
    types: list[str] = MOVEMENTS,
) -> StreamingQuery:
    """Posts a stream of movement forms (submission_id, part_num, type, quantity).

    Every micro-batch owns one folder, numbers its rows after all earlier folders and the
    ``opening`` ledger, and overwrites its folder when it is replayed, so a restart
    neither loses nor repeats a movement.
    """

    def post(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            earlier = read_ledger(spark, path).filter(F.col("arrival") < batch_id)
            ledger = opening.unionByName(earlier.drop("arrival"))
        else:
            ledger = opening
        posting = post_movements(Tables.of(stock_update=ledger), batch, as_of, types)
        posting.added[LEDGER].write.mode("overwrite").parquet(f"{path}/arrival={batch_id}")
        posting.rejects.write.mode("overwrite").parquet(f"{path}_rejects/arrival={batch_id}")

    return (
        forms.writeStream.foreachBatch(post)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_into(
    store: Store,
    name: str,
    forms: DataFrame,
    checkpoint: str,
    as_of: dt.date,
    types: list[str] = MOVEMENTS,
) -> StreamingQuery:
    """Posts a stream of movement forms to the ledger of ``store``, one version a micro-batch.

    Numbers follow the store's highest one, so no earlier row is read. A micro-batch is saved under its
    name, so one that is replayed after a failure changes nothing; other writers of the ledger may
    come in between."""

    def post(batch: DataFrame, batch_id: int) -> None:
        def build(base):
            return post_movements(store.tables(base), batch, as_of, types)

        store.post(build, f"{name}-{batch_id}")
        rejects = build(store.manifest()).rejects
        rejects.write.mode("overwrite").parquet(f"{store.root}/rejects/{name}/arrival={batch_id}")

    return (
        forms.writeStream.foreachBatch(post)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
