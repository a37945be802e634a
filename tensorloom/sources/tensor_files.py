"""Raw tensor files: consecutive samples, each size * extent little-endian floats; read by Spark, from any store it reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, components: DataFrame) -> DataFrame:
    """The long tensor of all float components whose files are in the folder; a file that is not of its declared size raises ValueError."""
    files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("bin"), "content")
    wanted = components.where(F.col("type").isin("float16_t", "float32_t", "float64_t")).select(F.col("path").alias("series"), F.substring_index("bin", "/", -1).alias("bin"), "samples", "size", "extent", "bits")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["samples"], r["size"], r["extent"])
                if len(r["content"]) != int(np.prod(shape)) * r["bits"] // 8:
                    raise ValueError(f"{r['bin']} has {len(r['content'])} bytes, which is not {shape} of {r['bits']} bits")
                x = np.frombuffer(r["content"], f"<f{r['bits'] // 8}").astype(np.float64)
                at = np.indices(shape, np.int32).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array([r["series"]] * x.size), pa.array(at[0]), pa.array(at[1].astype(np.int64)), pa.array(at[2]), pa.array(x)], ["series", "sample", "vertex", "coord", "value"])

    return files.join(wanted, "bin").mapInArrow(run, "series string, sample int, vertex long, coord int, value double")


def contents(t: DataFrame, bits: int = 64) -> DataFrame:
    """series, content binary: each series as the bytes of a raw file (one task holds one series)."""
    if bits not in (16, 32, 64):
        raise ValueError("floats have 16, 32 or 64 bits")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("sample", "vertex", "coord")])
        return pa.table({"series": [table.column("series")[0].as_py()], "content": pa.array([table.column("value").to_numpy().astype(f"<f{bits // 8}").tobytes()], pa.binary())})

    return t.groupBy("series").applyInArrow(run, "series string, content binary")


def write(files: DataFrame, folder: str) -> None:
    """Rows (bin, content) as files of a folder, written by the executors through Hadoop's file systems' local view.

    folder: a path that all workers mount. Each file appears whole or not at all.
    """

    def save(rows) -> None:
        import os
        import uuid

        for r in rows:
            target = os.path.join(folder, r["bin"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, target)

    files.select("bin", "content").foreachPartition(save)
