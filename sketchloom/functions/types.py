"""Schemas of the sketch columns."""

from pyspark.sql import types as T

STATS = T.StructType([T.StructField("count", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("sum", "min", "max", "m2", "m3", "m4")])
CENTROID = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("weight", T.DoubleType())])
TDIGEST = T.StructType([T.StructField(n, T.DoubleType()) for n in ("compression", "min", "max", "total_weight")] + [T.StructField("centroids", T.ArrayType(CENTROID))])


def counter(item: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("item", item), T.StructField("count", T.LongType()), T.StructField("error", T.LongType())])


def space_saving(item: T.DataType) -> T.StructType:
    """``m`` bounds the count of any item that is absent; 0 while nothing was ever dropped."""
    return T.StructType([T.StructField("capacity", T.IntegerType()), T.StructField("m", T.LongType()), T.StructField("counters", T.ArrayType(counter(item)))])
