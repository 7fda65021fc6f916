"""A report's text from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.operators import measure


def bullets(gaps: DataFrame) -> list[str]:
    """One line for each statement; the aggregates are a few rows, whatever the table's size."""
    s = measure.report(gaps).first()
    by = measure.counts(gaps.where("reliable"), "composition").collect()
    if not s["total"]:
        return ["No section was measured."]
    if not s["measured"]:
        return [f"All {s['total']} sections lie in shadow."]
    return [
        f"Measured sections: {s['measured']} of {s['total']} ({s['in_shadow']} in shadow).",
        f"Median gap: {s['median_gap']:.2f} m.",
        f"Without a separating strip: {s['no_strip_percent']:.0f} %.",
        "Between road and lane: " + ", ".join(f"{r['n']} {r['composition']}" for r in by) + ".",
    ]


def markdown(gaps: DataFrame, surface: DataFrame, title: str) -> str:
    """The report; ``surface`` has one row for each part of the road's surface, with its size."""
    road = surface.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("size"), F.lit(0)).alias("px")).first()
    lines = [f"# {title}", "", "## Road surface", "", f"- {road['px']} pixels in {road['parts']} parts.", "", "## Gap", "", *[f"- {b}" for b in bullets(gaps)], ""]
    return "\n".join(lines)


def save(text: str, spark, path: str) -> None:
    """A text of a few kilobytes as one file, through Spark, so that any store will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
