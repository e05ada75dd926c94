"""The model that a JSON text names, searched object by object.

An object is asked before what it holds: first the names under which it counts usage, then the keys that name a model, in
their rank; only then its members in the order of their keys, and a list's in their place. The first name of a known kind
counts; `default` only counts if the whole text has no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.operators.tables import written
from agentlens.sources.store_changes import MODEL_KEYS, MODEL_PARTS

# fixed values: what names a model that is an object, in rank
NAME_KEYS = ("name", "slug", "id", "model")
MEMBERS = "map<string,variant>"


def members(value: Column) -> Column:
    """An object's members; null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value.try_cast(MEMBERS))


def with_inner(values: Column, depth: int) -> Column:
    """Each value and, after it, what its naming keys hold, in rank, `depth` objects deep."""
    if not depth:
        return values
    inner = lambda x: F.transform(F.array(*map(F.lit, NAME_KEYS)), lambda k: members(x)[k])
    return F.flatten(F.transform(values, lambda x: F.concat(F.array(x), with_inner(inner(x), depth - 1))))


def names(values: Column, depth: int = 3) -> Column:
    """The names that values give, in rank: a text is one, an object has those of its naming keys."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string")))
    return F.array_compact(F.transform(with_inner(values, depth), text))


def model_names(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, model_name) of every row; null where the text names none or is no JSON. A step for each level of the deepest text."""
    nodes = written(rows.select(*keys, F.array().cast("array<string>").alias("_path"), F.try_parse_json(value).alias("_node")).filter("_node IS NOT NULL"))
    found = []
    while not nodes.isEmpty():
        held = nodes.withColumn("_members", members(F.col("_node")))
        used = F.map_keys(members(F.col("_members")["usageData"]))
        none = F.array().cast("array<string>")
        told = F.concat(F.coalesce(used, none), names(F.transform(F.array(*map(F.lit, MODEL_KEYS)), lambda k: F.col("_members")[k])))
        usable = F.filter(told, lambda x: F.lower(x).rlike("|".join(MODEL_PARTS)) | (F.lower(x) == "default"))
        found.append(written(held.filter("_members IS NOT NULL").select(*keys, "_path", F.posexplode(usable).alias("_rank", "_name"))))
        entries = F.transform(F.map_entries("_members"), lambda e: F.struct(e["key"].alias("step"), e["value"].alias("node")))
        listed = F.when(F.schema_of_variant("_node").startswith("ARRAY"), F.transform(F.col("_node").try_cast("array<variant>"), lambda x, i: F.struct(F.lpad(i.cast("string"), 10, "0").alias("step"), x.alias("node"))))
        below = held.select(*keys, "_path", F.explode(F.coalesce(entries, listed)).alias("_e")).select(*keys, F.concat("_path", F.array("_e.step")).alias("_path"), F.col("_e.node").alias("_node"))
        nodes = written(below.filter(F.schema_of_variant("_node").rlike("^(OBJECT|ARRAY)")))
    if not found:
        return rows.select(*keys, F.lit(None).cast("string").alias("model_name"))
    default = F.lower("_name") == "default"
    best = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.min_by("_name", F.struct(default, "_path", "_rank")).alias("_name"))
    return rows.select(*keys).join(best.withColumn("model_name", F.when(F.lower("_name") == "default", "default").otherwise(F.col("_name"))).drop("_name"), keys, "left")
