"""Boxes on pages: overlap measures, duplicate regions, paragraphs from lines, the gutter of two-column pages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which block type stays of two that cover each other.
PRIORITY = {"table": 10, "image": 5, "text": 3, "equation": 3, "code": 3, "list": 3}
BOX = ("x0", "y0", "x1", "y1")


def _side(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(f"{a}.{high}"), F.col(f"{b}.{high}")) - F.greatest(F.col(f"{a}.{low}"), F.col(f"{b}.{low}")))


def area(a: str) -> Column:
    return (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs; 0 for boxes without area."""
    both = _side(a, b, "x0", "x1") * _side(a, b, "y0", "y1")
    return F.coalesce(F.try_divide(both.cast("double"), area(a) + area(b) - both), F.lit(0.0))


def containment(inner: str, outer: str) -> Column:
    """Share of the inner box inside the outer."""
    return F.coalesce(F.try_divide((_side(inner, outer, "x0", "x1") * _side(inner, outer, "y0", "y1")).cast("double"), area(inner)), F.lit(0.0))


def overlapping(blocks: DataFrame, page: list[str], order: str, least: float = 0.9) -> DataFrame:
    """(page, first, second, iou): blocks of one page that cover each other by more than ``least``.

    Two boxes whose overlap exceeds ``least`` of their union differ in either side by less than a factor of ``least``, and
    their corners by less than 1 / ``least`` - 1 of a side. So blocks meet through the logarithm of their width and
    height and the place of their corner in units of the side, each with its neighbours: complete for any ``least`` from 0.5 on.
    """
    if not 0.5 <= least < 1:
        raise ValueError(f"least is {least}")
    # one step of the logarithm holds sides that differ by the factor; corners are at most one cell apart
    step = -math.log(least)
    side = lambda low, high: F.greatest(F.col(high) - F.col(low), F.lit(1)).cast("double")
    cell = {"_w": F.floor(F.log(side("x0", "x1")) / step), "_h": F.floor(F.log(side("y0", "y1")) / step)}
    boxed = blocks.where("x1 > x0 and y1 > y0").withColumn("box", F.struct(*BOX)).withColumns(cell)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    unit = lambda k: F.exp((F.col(k) + 1) * step)
    place = {"_x": F.floor(F.col("x0") / unit("_w")), "_y": F.floor(F.col("y0") / unit("_h"))}
    own = boxed.withColumns(place).select(*page, F.col(order).alias("first"), F.col("box").alias("a"), "_w", "_h", "_x", "_y")
    shifts = F.explode(F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    other = boxed.withColumn("_s", shifts).withColumns({"_w": F.col("_w") + F.col("_s.i"), "_h": F.col("_h") + F.col("_s.j")}).withColumns(place)
    other = other.withColumn("_s", shifts).withColumns({"_x": F.col("_x") + F.col("_s.i"), "_y": F.col("_y") + F.col("_s.j")})
    other = other.select(*page, F.col(order).alias("second"), F.col("box").alias("b"), "_w", "_h", "_x", "_y")
    met = own.join(other, [*page, "_w", "_h", "_x", "_y"]).where("first < second").withColumn("iou", iou("a", "b"))
    return met.where(F.col("iou") > least).select(*page, "first", "second", "iou")


def _covering(box: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` cover ``box`` by more than ``least``."""
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    both = np.maximum(0, w) * np.maximum(0, h)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    union = area(box) + area(others) - both
    return (union > 0) & (both > least * union)


def dedup_regions(blocks: DataFrame, page: list[str], order: str, least: float = 0.9) -> DataFrame:
    """Greedy in reading order: of two regions of a page that cover each other the one of higher priority stays, else the earlier."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)
        boxes, rank = rows[list(BOX)].to_numpy(dtype=np.float64), np.array([PRIORITY.get(t, 1) for t in rows["type"]])
        kept: list[int] = []
        for i in range(len(rows)):
            met = np.flatnonzero(_covering(boxes[i], boxes[kept], least)) if kept else []
            if not len(met):
                kept.append(i)
            elif rank[i] > rank[kept[met[0]]]:
                kept[met[0]] = i
        return rows.iloc[sorted(kept)]

    return blocks.groupBy(*page).applyInPandas(fold, blocks.schema)


def merge_lines(lines: DataFrame, page: list[str], overlap: float = 0.6, gap: float = 1.2) -> DataFrame:
    """Lines (x0, y0, x1, y1, text) to paragraphs: a line joins the paragraph above if their columns overlap and the gap is small."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values(["y0", "x0"]).to_dict("records"):
            last = out[-1] if out else None
            if last:
                shared = min(last["x1"], r["x1"]) - max(last["x0"], r["x0"])
                narrow = max(1, min(last["x1"] - last["x0"], r["x1"] - r["x0"]))
                if shared / narrow >= overlap and r["y0"] - last["y1"] <= gap * max(1, r["y1"] - r["y0"]):
                    wide = last["text"][-1:] >= "\u3000" or r["text"][:1] >= "\u3000"
                    last["text"] += ("" if wide else " ") + r["text"]
                    last["x0"], last["x1"], last["y1"] = min(last["x0"], r["x0"]), max(last["x1"], r["x1"]), max(last["y1"], r["y1"])
                    continue
            out.append(r)
        return pd.DataFrame(out, columns=pdf.columns)

    return lines.groupBy(*page).applyInPandas(fold, lines.schema)


def gutters(blocks: DataFrame, page: list[str], step: int = 5) -> DataFrame:
    """(page, gutter): centre of the widest run of x probes in the middle half that the fewest boxes cross."""
    from pyspark.sql import Window

    probes = blocks.select(*page).distinct().withColumn("x", F.explode(F.sequence(F.lit(250), F.lit(750), F.lit(step))))
    crossed = blocks.select(*page, F.explode(F.sequence(F.ceil(F.greatest(F.col("x0") + 1, F.lit(250)) / step) * step, F.greatest(F.ceil(F.greatest(F.col("x0") + 1, F.lit(250)) / step) * step, F.floor(F.least(F.col("x1") - 1, F.lit(750)) / step) * step), F.lit(step).cast("bigint"))).alias("x"), "x0", "x1")
    hits = crossed.where("x > x0 and x < x1 and x <= 750").groupBy(*page, F.col("x").cast("int").alias("x")).agg(F.count("*").alias("n"))
    counted = probes.join(hits, [*page, "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = counted.withColumn("least", F.min("n").over(Window.partitionBy(*page))).where("n = least")
    islands = least.withColumn("island", F.col("x") - step * F.row_number().over(Window.partitionBy(*page).orderBy("x")))
    runs = islands.groupBy(*page, "island").agg(F.count("*").alias("width"), F.min("x").alias("a"), F.max("x").alias("b"))
    return runs.groupBy(*page).agg(F.max_by(((F.col("a") + F.col("b")) / 2), F.struct("width", -F.col("a"))).alias("gutter"))
