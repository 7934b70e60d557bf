"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, table  # noqa: F401


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spread(df: DataFrame, n: int, column: str) -> DataFrame:
    """Send the rows with number b in the column to partition b modulo n."""
    return df.repartitionById(n, F.pmod(F.col(column), F.lit(n)).cast("int"))


def batches(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

