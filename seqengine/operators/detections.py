"""Boxes found in rows (FIL06, PRJ21, PRJ23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOXES = "array<struct<x1: double, y1: double, x2: double, y2: double, conf: double, class_id: int>>"


def confident(boxes: Column, least: float = 0.25) -> Column:
    """The boxes with a confidence above the least (FIL06)."""
    return F.filter(boxes, lambda b: b["conf"] > least)


def rescaled(boxes: Column, scale_x: Column, scale_y: Column) -> Column:
    """Boxes of the model's size brought to the image's (PRJ21)."""
    return F.transform(boxes, lambda b: F.struct((b["x1"] * scale_x).alias("x1"), (b["y1"] * scale_y).alias("y1"), (b["x2"] * scale_x).alias("x2"), (b["y2"] * scale_y).alias("y2"), b["conf"].alias("conf"), b["class_id"].alias("class_id")))


def box_rows(df: DataFrame, keys: list[str], boxes: str) -> DataFrame:
    """A row for each box."""
    return df.select(*keys, F.explode(boxes).alias("_box")).select(*keys, "_box.*")


def caption(label: Column, score: Column) -> Column:
    """Label and score in whole percent (PRJ23)."""
    return F.concat(label, F.lit(" "), (score * 100).cast("int"), F.lit("%"))


def tinted(pixel: Column, colour: Column, alpha: float = 0.3) -> Column:
    """A pixel under a filled box (PRJ23)."""
    return (1 - alpha) * pixel + alpha * colour
