"""Object annotations in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_ids

SCHEMA = (
    "object array<struct<bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>, name: string, difficult: boolean, truncated: boolean>>, "
    "size struct<width: int, height: int, depth: int>"
)


def parse_annotations(df: DataFrame, json_col: str, class_names: list[str]) -> DataFrame:
    """Adds width, height, depth, ``boxes`` and ``_error`` (a missing field or an unknown class; boxes are then null)."""
    ids = F.create_map(*(F.lit(x) for kv in class_ids(class_names).items() for x in kv))
    rec = F.from_json(json_col, SCHEMA)
    df = df.withColumn("_rec", rec)
    o = F.col("_rec.object")
    sides = ("xmin", "ymin", "xmax", "ymax")
    box = lambda x: F.struct(*(x["bndbox"][s].alias(s) for s in sides), F.try_element_at(ids, x["name"]).alias("label"), F.coalesce(x["difficult"], F.lit(False)).alias("difficult"), F.coalesce(x["truncated"], F.lit(False)).alias("truncated"))
    df = df.withColumn("_boxes", F.transform(o, box))
    missing = lambda what: F.lit(f"Error parsing annotation: '{what}' is missing")
    size = F.col("_rec.size")
    error = F.coalesce(
        F.when(o.isNull(), missing("object")),
        F.when(size.isNull() | size["width"].isNull() | size["height"].isNull() | size["depth"].isNull(), missing("size")),
        F.when(F.exists(o, lambda x: x["name"].isNull()), missing("name")),
        F.when(F.exists("_boxes", lambda b: b["xmin"].isNull() | b["ymin"].isNull() | b["xmax"].isNull() | b["ymax"].isNull()), missing("bndbox")),
        F.when(F.exists("_boxes", lambda b: b["label"].isNull()), F.lit("label not found in class_names")),
    )
    df = df.withColumn("_error", error).withColumn("boxes", F.when(F.col("_error").isNull(), F.col("_boxes")))
    return df.withColumns({k: F.col(f"_rec.size.{k}") for k in ("width", "height", "depth")}).drop("_rec", "_boxes")
