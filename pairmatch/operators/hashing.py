"""What every vector hash has in common: bits and packed signatures per Arrow batch."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.arrow import to_lists, to_matrix
from pairmatch.functions.bands import BandLayout


class HashModel(ABC):
    """A fitted hash.  The model travels as a broadcast variable of fixed, checked size."""

    @property
    @abstractmethod
    def bits(self) -> int: ...

    @property
    @abstractmethod
    def dim(self) -> int: ...

    @abstractmethod
    def hash_bits(self, x: np.ndarray) -> np.ndarray:
        """[n, dim] vectors to [n, bits] zeros and ones."""

    @property
    def digest(self) -> str:
        """Names the fitted model: the same for the same numbers."""
        state = hashlib.sha256(type(self).__name__.encode())
        for field in fields(self):
            values = np.ascontiguousarray(getattr(self, field.name), dtype=np.float64)
            state.update(repr(values.shape).encode() + values.tobytes())
        return state.hexdigest()

    def layout(self, rows: int) -> BandLayout:
        return BandLayout(self.bits, rows)

    def transform(self, df: DataFrame, vec: str = "vec", out: str = "bits") -> DataFrame:
        """Add the 0/1 hash bits; one matrix product per Arrow batch."""
        return df.withColumn(out, self._rows_of(df, vec, "hash_bits", T.ByteType(), pa.int8()))

    def _rows_of(self, df, vec, method, spark_type, arrow_type):
        """Column with the row of a matrix method for each vector."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(T.ArrayType(spark_type))
        def to_rows(column: pa.Array) -> pa.Array:
            x, present = to_matrix(column, shared.value.dim)
            return to_lists(getattr(shared.value, method)(x), present, arrow_type)

        return to_rows(F.col(vec))

    def signatures(
        self,
        df: DataFrame,
        layout: BandLayout,
        id_col: str = "id",
        vec: str = "vec",
        keep: Sequence[str] = (),
    ) -> DataFrame:
        """(id, sig, …): the bits packed by ``layout``, a few words per vector."""
        if layout.bits != self.bits:
            raise ValueError(f"the model has {self.bits} bits, the layout {layout.bits}")
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def to_words(column: pa.Array) -> pa.Array:
            x, present = to_matrix(column, shared.value.dim)
            return to_lists(layout.pack(shared.value.hash_bits(x)), present, pa.int64())

        # vectors are filtered first: a filter on the signature would hash every row twice
        return df.where(F.col(vec).isNotNull()).select(
            F.col(id_col).alias("id"), to_words(F.col(vec)).alias("sig"), *keep
        )
