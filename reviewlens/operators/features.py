"""Feature specifications: a list of named double expressions.

Detectors work on a fixed list of feature expressions, built either from
numeric columns or from the elements of an array/vector column. Expressions
stay JVM-side and are unrolled per feature, so projections are codegen'd and
Catalyst prunes unused input columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    cols: tuple[str, ...] = ()
    vector: str | None = None
    dim: int = 0

    @staticmethod
    def of(df: DataFrame, cols: list[str] | None = None, vector: str | None = None) -> "FeatureSpec":
        if vector is not None:
            dt = df.schema[vector].dataType.simpleString()
            if dt.startswith("array"):
                dim = df.select(F.max(F.size(vector)).alias("d")).first()["d"] or 0
            else:  # ml VectorUDT
                from pyspark.ml.functions import vector_to_array
                dim = df.select(F.max(F.size(vector_to_array(F.col(vector)))).alias("d")).first()["d"] or 0
            return FeatureSpec((), vector, int(dim))
        return FeatureSpec(tuple(cols or ()), None, len(cols or ()))

    @property
    def names(self) -> list[str]:
        if self.vector is not None:
            return [f"{self.vector}[{i}]" for i in range(self.dim)]
        return list(self.cols)

    def exprs(self, df: DataFrame | None = None) -> list[Column]:
        if self.vector is not None:
            v = F.col(self.vector)
            if df is not None and not df.schema[self.vector].dataType.simpleString().startswith("array"):
                from pyspark.ml.functions import vector_to_array
                v = vector_to_array(v)
            return [F.get(v, i).cast("double") for i in range(self.dim)]
        return [F.col(c).cast("double") for c in self.cols]

    def slice(self, indices: list[int]) -> "SlicedSpec":
        """Keep only ``indices`` (e.g. the first d // 2 features)."""
        return SlicedSpec(self, tuple(indices))

    def input_cols(self) -> list[str]:
        return [self.vector] if self.vector is not None else list(self.cols)


@dataclass(frozen=True)
class SlicedSpec:
    """A feature spec restricted to some indices (P13 mask, P15 max_features)."""
    base: FeatureSpec
    indices: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.indices)

    @property
    def names(self) -> list[str]:
        n = self.base.names
        return [n[i] for i in self.indices]

    def exprs(self, df: DataFrame | None = None) -> list[Column]:
        e = self.base.exprs(df)
        return [e[i] for i in self.indices]

    def input_cols(self) -> list[str]:
        return self.base.input_cols()
