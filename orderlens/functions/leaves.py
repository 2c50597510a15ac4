"""All leaves of nested documents, by their schema or without one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType

from orderlens.functions.rows import unpack
from orderlens.session import stage


def _join(path: Column | None, step: Column) -> Column:
    return step if path is None else F.concat_ws(".", path, step)


LEAF = "struct<path:string,text:string,value:double>"


def _leaves(value: Column, kind: DataType, path: Column | None) -> Column:
    """An array of ``(path, text, value)``: numbers as values, all else that isn't nested as text."""
    none = F.array().cast(f"array<{LEAF}>")
    if isinstance(kind, StructType):
        inner = [F.coalesce(_leaves(value[f.name], f.dataType, _join(path, F.lit(f.name))), none) for f in kind.fields]
        return F.concat(*inner) if inner else none
    if isinstance(kind, MapType):
        entries = F.map_entries(value)
        return F.flatten(F.transform(entries, lambda e: _leaves(e["value"], kind.valueType, _join(path, e["key"]))))
    if isinstance(kind, ArrayType):
        return F.flatten(
            F.transform(value, lambda e, i: _leaves(e, kind.elementType, _join(path, i.cast("string"))))
        )
    number = isinstance(kind, NumericType)
    leaf = F.struct(path, value.cast("string") if not number else F.lit(None), value if number else F.lit(None))
    return F.array(leaf.cast(LEAF))


def leaves(documents: DataFrame) -> DataFrame:
    """Every leaf of every document as ``(path, text, value)``; NULLs are left out."""
    found = unpack(documents, _leaves(F.struct(*documents.columns), documents.schema, None))
    return found.filter(F.col("value").isNotNull() | F.col("text").isNotNull())


def json_leaves(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """Every leaf of JSON texts of any shape, as ``(keys, path, text, value)``; no schema is asked for.

    Texts are parsed as VARIANT. A level of nesting is one step: leaves are kept, objects and
    arrays are exploded into the next level, until none is nested; so the number of steps is the
    depth of the deepest document, and each step reads only what is still nested. Numbers are
    values, strings and booleans text, nulls are left out, as are texts that are no JSON; names
    and positions are joined by full stops, and a document that is one leaf has an empty path.
    """
    spark = documents.sparkSession
    parsed = documents.select(*keys, F.lit(None).cast("string").alias("_path"), F.try_parse_json(column).alias("_v"))
    found = []
    while True:
        typed = parsed.withColumn("_kind", F.schema_of_variant("_v"))
        typed = typed.where("_kind <> 'VOID'").withColumn("_nested", F.col("_kind").rlike("^(OBJECT|ARRAY)"))
        # a level is kept as text again, which any file format holds
        level = stage(typed.select(*keys, "_path", "_kind", "_nested", F.to_json("_v").alias("_json")), "json-level")
        value = F.try_variant_get(F.parse_json("_json"), "$", "double")
        number = F.col("_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        leaf = level.where("NOT _nested")
        text = F.when(~number, F.try_variant_get(F.parse_json("_json"), "$", "string"))
        found.append(leaf.select(*keys, F.coalesce("_path", F.lit("")).alias("path"), text.alias("text"), F.when(number, value).alias("value")))
        nested = level.where("_nested")
        if nested.isEmpty():
            return reduce(DataFrame.unionByName, found)
        inner = nested.select(*keys, "_path", F.parse_json("_json").alias("_v"))
        inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
        step = F.coalesce("_key", F.col("_pos").cast("string"))
        parsed = inner.select(*keys, F.concat_ws(".", "_path", step).alias("_path"), F.col("_value").alias("_v"))


def numeric_leaves(documents: DataFrame) -> DataFrame:
    """Every number of every document as ``(path, value)``; booleans are not numbers."""
    return leaves(documents).filter(F.col("value").isNotNull()).select("path", "value")
