"""Schemas of the table families."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

FRAGMENTS = _schema(sample=_S, chr=_S, start_pos=_L, end_pos=_L, barcode=_S)
FEATURES = _schema(matrix=_S, chr=_S, idx=_L, start_pos=_L, end_pos=_L, name=_S, strand=_S)
MATRIX = _schema(matrix=_S, sample=_S, chr=_S, feature=_L, cell=_S, value=_D)
CELLS = _schema(cell=_S, sample=_S)
VECTORS = _schema(name=_S, cell=_S, v=T.ArrayType(_D))
GENES = _schema(gene_id=_L, symbol=_S, chr=_S, start_pos=_L, end_pos=_L, strand=_S)
INTERVALS = _schema(chr=_S, start_pos=_L, end_pos=_L)


def require(schema: T.StructType, columns: list[str], what: str) -> None:
    """Raise ValueError if a column is missing."""
    missing = [c for c in columns if c not in schema.names]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
