"""Quantise and difference values as they arrive, keyed by vertex, with the last multiple kept as state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import quantised
from ..tables import shared_dir


def stream_deltas(values: DataFrame, quality: float, watermark: str = "10 minutes") -> DataFrame:
    """vertex, ts, id, quantised, delta of a stream of vertex, ts, id, value.

    Within a micro-batch, values of a vertex are taken by ts and id; a value that arrives in a later batch follows the
    ones before it, whatever its time, and values later than the watermark are left out.
    """

    def step(key, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        before = state.get[0] if state.exists else 0
        rows["delta"] = rows["quantised"].diff().fillna(rows["quantised"].iloc[0] - before).astype("int64")
        state.update((int(rows["quantised"].iloc[-1]),))
        rows["vertex"] = key[0]
        yield rows[["vertex", "ts", "id", "quantised", "delta"]]

    timely = values.withWatermark("ts", watermark).select("vertex", "ts", "id", quantised(F.col("value"), quality).alias("quantised"))
    return timely.groupBy("vertex").applyInPandasWithState(step, "vertex long, ts timestamp, id long, quantised long, delta long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what its source has now into a table of the shared folder, which is returned."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tensorloom/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def window_sizes(deltas: DataFrame, window: str, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling windows of a stream of ts, delta: window start, n, base, greatest delta."""
    return deltas.withWatermark("ts", watermark).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.min("delta").alias("base"), F.max("delta").alias("most")).select(F.col("window.start").alias("start"), "n", "base", "most")
