"""GeoJSON feature collections as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_hash, file_bytes, id, kind, properties, geometry, failed): a row for each feature of whole files.

    A file of which one feature is malformed (type, properties no object, no
    coordinates) gives one row with failed 'file'. A good feature without an id,
    its own or properties' '@id', has failed 'id'. properties and geometry are
    JSON texts.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    base = files.select("file", F.sha2("value", 256).alias("file_hash"), F.octet_length("value").alias("file_bytes"), F.try_parse_json("value").alias("v"))
    whole = base.withColumn("list", F.try_variant_get("v", "$.features", "array<variant>"))
    text = lambda x, p: F.to_json(F.try_variant_get(x, p, "variant"))
    kind_of = lambda x, p: F.schema_of_variant(F.try_variant_get(x, p, "variant"))
    good = lambda x: (F.try_variant_get(x, "$.type", "string") == "Feature") & kind_of(x, "$.properties").startswith("OBJECT") & kind_of(x, "$.geometry.coordinates").startswith("ARRAY")
    checked = whole.withColumn("ok", F.coalesce((F.try_variant_get("v", "$.type", "string") == "FeatureCollection") & F.forall("list", lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False)))
    rejected = checked.where(~F.col("ok")).select("file", "file_hash", "file_bytes", *[F.lit(None).cast("string").alias(c) for c in ("id", "kind", "properties", "geometry")], F.lit("file").alias("failed"))
    each = checked.where("ok").select("file", "file_hash", "file_bytes", F.explode("list").alias("x"))
    x = F.col("x")
    ident = F.coalesce(F.try_variant_get(x, "$.id", "string"), F.try_variant_get(x, "$.properties['@id']", "string"))
    rows = each.select("file", "file_hash", "file_bytes", ident.alias("id"), F.try_variant_get(x, "$.geometry.type", "string").alias("kind"), text(x, "$.properties").alias("properties"), text(x, "$.geometry").alias("geometry"), F.when(ident.isNull(), "id").alias("failed"))
    return rows.unionByName(rejected)
