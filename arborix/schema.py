"""Canonical relations.

tables   one row a table, with its header paths by position
cells    one row a data value: the workhorse of every operator
chunks   a piece of text that covers some rows and columns of a table
queries  a question with its gold table and answer
operands the cells that a gold answer depends on
hits     ranked chunks of a query
ranks    the rank of each operand under a scheme and retriever, null if absent
"""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_PATH = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
TABLES = _struct(table_id=S, title=S, source=S, n_rows=I, n_cols=I, top_paths=T.ArrayType(_PATH), left_paths=T.ArrayType(_PATH))
CELLS = _struct(table_id=S, title=S, r=I, c=I, raw=S, num=D, row_path=_PATH, col_path=_PATH)
CHUNKS = _struct(chunk_id=S, table_id=S, scheme=S, kind=S, text=S, rows=T.ArrayType(I), cols=T.ArrayType(I))
QUERIES = _struct(query_id=S, question=S, table_id=S, answer=T.ArrayType(S), aggregation=S, split=S, source=S)
OPERANDS = _struct(query_id=S, table_id=S, r=I, c=I, value=D, value_type=S)
HITS = _struct(query_id=S, chunk_id=S, rank=I, score=D)
RANKS = _struct(scheme=S, retriever=S, query_id=S, cell=S, rank=I, colliding=T.BooleanType(), total_like=T.BooleanType())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a relation, cast to its types; other columns go."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
