"""Schema repair: one type for each field of a layer, preview and verification.

Types form a lattice: a field whose values all have one type keeps it; texts that all read as numbers (or as true and
false) join numbers (or booleans); anything else meets in text. One aggregate over (layer, field) decides and counts at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodiag.model import CheckContext, Dataset
from geodiag.operators import rules
from geodiag.runtime import materialize

_TYPES = ("string", "number", "boolean", "array", "object")
#: JSON's numbers
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _text(json: Column) -> Column:
    """The text of a JSON string."""
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


def preview(data: Dataset) -> DataFrame:
    """What :func:`normalize` would do: a row for each layer and field.

    ``layer_idx, field, target`` (null if all values are null), ``n_values`` (not null), ``n_cast`` (of another type than the target),
    ``n_null`` (null values) and ``n_added`` (features without the field, which get a null); all long. Layers without properties have no row.
    Features are counted by rows, repeated ones included.
    """
    fields = data.features.select("layer_idx", F.explode("properties").alias("field", "value"))
    kind = rules.value_type(F.col("value"))
    # texts are only read where a field has them
    typed = fields.withColumn("kind", kind).withColumn("t", F.when(F.col("kind") == "string", F.trim(_text(F.col("value")))))
    count = lambda c: F.count_if(c)
    agg = typed.groupBy("layer_idx", "field").agg(
        *(count(F.col("kind") == t).alias(t) for t in _TYPES), count(F.col("kind") == "null").alias("n_null"), F.count(F.lit(1)).alias("n"),
        count(F.col("t").rlike(_NUMBER)).alias("as_number"), count(F.col("t").isin("true", "false")).alias("as_boolean"),
    )
    values = sum((F.col(t) for t in _TYPES[1:]), F.col("string"))
    alone = F.coalesce(*(F.when((F.col(t) > 0) & (F.col(t) == values), F.lit(t)) for t in _TYPES))
    joined = F.when((F.col("number") + F.col("as_number") == values) & (F.col("number") > 0), "number").when((F.col("boolean") + F.col("as_boolean") == values) & (F.col("boolean") > 0), "boolean")
    target = F.when(values > 0, F.coalesce(alone, joined, F.lit("string")))
    own = F.coalesce(*(F.when(F.col("target") == t, F.col(t)) for t in _TYPES), F.lit(0))
    sizes = data.features.groupBy("layer_idx").agg(F.count(F.lit(1)).alias("features"))  # a row for each layer
    out = agg.withColumn("target", target).withColumn("n_values", values).join(sizes, "layer_idx")
    return out.select("layer_idx", "field", "target", "n_values", (F.col("n_values") - own).alias("n_cast"), "n_null", (F.col("features") - F.col("n")).alias("n_added"))


def cast(json: Column, target: Column) -> Column:
    """A value's JSON text in another type; null stays null."""
    kind = rules.value_type(json)
    return F.when(kind == "null", "null").when((kind == target) | target.isNull(), json).when(target.isin("number", "boolean"), F.trim(_text(json))).otherwise(_quoted(json))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def normalize(data: Dataset) -> Dataset:
    """Every feature with all fields of its layer, each in the field's one type; missing ones are null. Order, ids and geometries stay.

    The fields of a layer meet its features as one small row (the distinct fields of a layer). These rows are written first, so that their
    size is known when the join is planned: Catalyst then broadcasts them and deals no features by layer, or sorts both if they are large.
    Values of mixed fields become texts: a number or object is its JSON text.
    """
    fields = materialize(preview(data).groupBy("layer_idx").agg(F.sort_array(F.collect_list(F.struct("field", "target"))).alias("fields")), "fields")
    made = F.map_from_arrays(F.transform("fields", lambda f: f["field"]), F.transform("fields", lambda f: cast(F.element_at("properties", f["field"]), f["target"])))
    features = data.features.join(fields, "layer_idx", "left").withColumn("properties", F.when(F.col("fields").isNotNull(), made).otherwise(F.col("properties")))
    return Dataset(data.layers, features.select(data.features.columns), data.path)


def verify(before: Dataset, after: Dataset, ids: tuple[str, ...] = ("data/schema-validate",)) -> DataFrame:
    """Findings of some rules in two datasets: ``rule_id, severity, before, after``; a row for each that either has."""
    out = None
    for name, data in (("before", before), ("after", after)):
        ctx = CheckContext(data)
        for id in ids:
            found = rules.Registry().get(id).check(ctx).select("rule_id", "severity", F.lit(name).alias("when"))
            out = found if out is None else out.unionByName(found)
    at = lambda n: F.count_if(F.col("when") == n).alias(n)
    return out.groupBy("rule_id", "severity").agg(at("before"), at("after"))
