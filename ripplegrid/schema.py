"""Explicit schemas: names, types and order are part of the data's contract and are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    """A schema of "name type, name type"; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, T.StructType] = {
    "events": _schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
    "orders": _schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": _schema("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "customer": _schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": _schema("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": _schema("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int"),
    "region": _schema("r_regionkey int, r_name string"),
    "documents": _schema("doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "embeddings": _schema("vec_id bigint, embedding array<float>, label int"),
    "labels": _schema("doc_id bigint, quality int, toxic int"),
}


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df, if it has exactly the expected columns and types in the expected order; else ValueError."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    if have != want:
        raise ValueError(f"schema differs: {have} instead of {want}")
    return df
