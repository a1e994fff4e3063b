"""Models as tables: named arrays are written in blocks and read back exactly, so that a model trained in one run serves in another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = 65_536


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str, overwrite: bool = False) -> None:
    """(name, shape, dtype, block, bytes) rows: a block holds BLOCK numbers."""
    rows = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        flat = a.reshape(-1)
        for k in range(0, max(1, len(flat)), BLOCK):
            rows.append((name, list(a.shape), a.dtype.str, k // BLOCK, flat[k : k + BLOCK].tobytes()))
    df = spark.createDataFrame(rows, "name string, shape array<long>, dtype string, block int, bytes binary")
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """The arrays of a model, or some of them; a missing block is an error."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("name").isin(*names)) if names else rows
    found: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.name, r.block)):  # as large as the model
        found.setdefault(r.name, []).append(r)
    out = {}
    for name, parts in found.items():
        flat = np.frombuffer(b"".join(p.bytes for p in parts), parts[0].dtype)
        if [p.block for p in parts] != list(range(len(parts))) or len(flat) != int(np.prod(parts[0].shape)):
            raise ValueError(f"{name} lacks blocks")
        out[name] = flat.reshape(parts[0].shape)
    return out


def topic_shares_of(docs: DataFrame, phi: np.ndarray, alpha: np.ndarray, sweeps: int = 20) -> DataFrame:
    """Adds theta to rows with words array<int>, under the topics of a model (words, topics): for tables and for streams. Words outside
    the model count for nothing."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    from textloom.operators.topics import infer_theta

    shared = docs.sparkSession.sparkContext.broadcast((phi, alpha))

    def run(batches):
        p, a = shared.value
        for b in batches:
            theta = []
            for w in b.column("words").to_pylist():
                w = np.array(w or [], int)
                t = infer_theta(w[(w >= 0) & (w < len(p))], p, a, sweeps)
                theta.append([float(x) for x in t / t.sum()])
            yield b.append_column("theta", pa.array(theta, pa.list_(pa.float64())))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("theta", ArrayType(DoubleType()))]))
