"""Box expressions. A box is struct(x1, y1, x2, y2) with y running downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def _shared(a: Column, b: Column) -> tuple[Column, Column]:
    x = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    y = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return x, y


def overlaps(a: Column, b: Column) -> Column:
    """Whether the insides meet; touching edges don't count."""
    x, y = _shared(a, b)
    return (x > 0) & (y > 0)


def iou(a: Column, b: Column) -> Column:
    x, y = _shared(a, b)
    both = x * y
    union = width(a) * height(a) + width(b) * height(b) - both
    return F.when((x > 0) & (y > 0) & (union > 0), both / union).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def align(values: Column, page_width: Column, page_height: Column) -> Column:
    """A provider's [x1, y1, x2, y2] in page points: swapped, flipped, scaled from fractions and clipped.

    Anything but four numbers is the whole page. A box that spans the middle of
    the page is flipped about it; fractions are recognised after that.
    """
    at = lambda i: F.try_element_at(values, F.lit(i)).cast("double")
    # Each step is bound once, so that the expression doesn't double with every use of a coordinate.
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    given = F.struct(
        F.least(at(1), at(3)).alias("x1"), at(2).alias("y1"), F.greatest(at(1), at(3)).alias("x2"), at(4).alias("y2"), page_width.cast("double").alias("w"), page_height.cast("double").alias("h")
    )
    spans = lambda b: (b["y1"] < b["y2"]) & (b["y2"] > b["h"] / 2) & (b["y1"] < b["h"] / 2)
    flip = lambda b: F.struct(
        b["x1"].alias("x1"), F.when(spans(b), b["h"] - b["y2"]).otherwise(b["y1"]).alias("y1"), b["x2"].alias("x2"), F.when(spans(b), b["h"] - b["y1"]).otherwise(b["y2"]).alias("y2"), b["w"].alias("w"), b["h"].alias("h")
    )
    share = lambda b: b["x1"].between(0, 1) & b["x2"].between(0, 1) & b["y1"].between(0, 1) & b["y2"].between(0, 1)
    scale = lambda b: F.struct(
        F.when(share(b), b["w"]).otherwise(1.0).alias("sx"), F.when(share(b), b["h"]).otherwise(1.0).alias("sy"), b.alias("b")
    )
    fit = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    clip = lambda s: box(fit(s["b"]["x1"] * s["sx"], s["b"]["w"]), fit(s["b"]["y1"] * s["sy"], s["b"]["h"]), fit(s["b"]["x2"] * s["sx"], s["b"]["w"]), fit(s["b"]["y2"] * s["sy"], s["b"]["h"]))
    whole = box(F.lit(0.0), F.lit(0.0), page_width, page_height)
    return F.when(F.size(values) == 4, bind(bind(bind(given, flip), scale), clip)).otherwise(whole)
