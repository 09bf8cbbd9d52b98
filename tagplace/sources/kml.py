"""KML and JSON output: each row makes its own text, files are written in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import kml_color, ring_text, xml_escape

#: The markup of a cell, a style and a point.
_POLYGON = "<Placemark>\n<Style><LineStyle><width>2</width></LineStyle></Style>\n<Polygon><outerBoundaryIs><LinearRing><coordinates>\n%s</coordinates></LinearRing></outerBoundaryIs></Polygon>\n</Placemark>"
_STYLE = '<Style id="cell-%s"><IconStyle>\n<color>%s</color>\n<Icon><href>http://maps.google.com/mapfiles/kml/shapes/placemark_circle.png</href></Icon>\n</IconStyle></Style>'
_POINT = "<Placemark>\n<description>%s</description>\n<styleUrl>#cell-%s</styleUrl>\n<Point><coordinates>%s,%s</coordinates></Point>\n</Placemark>"


def _framed(parts: DataFrame) -> DataFrame:
    """(section, sort, value) with the document's first and last lines."""
    ends = parts.sparkSession.createDataFrame([(0, "", "<kml>\n<Document>"), (9, "", "</Document>\n</kml>")], "section int, sort string, value string")
    return parts.select("section", "sort", "value").unionByName(ends)


def cells_kml(cells: DataFrame) -> DataFrame:
    """section, sort, value of one Placemark per cell (label, ring) that has a ring."""
    return _framed(cells.where(F.col("ring").isNotNull()).select(F.lit(5).alias("section"), F.lpad(F.col("label").cast("string"), 12, "0").alias("sort"), F.format_string(_POLYGON, ring_text(F.col("ring"))).alias("value")))


def points_kml(points: DataFrame) -> DataFrame:
    """section, sort, value of a Style per cluster and a Placemark per row of (tags, lat, lon, cluster)."""
    key = F.coalesce(F.col("cluster").cast("string"), F.lit(""))
    styles = points.select(key.alias("c")).distinct().select(F.lit(3).alias("section"), F.col("c").alias("sort"), F.format_string(_STYLE, F.col("c"), kml_color(F.col("c"))).alias("value"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    places = points.select(F.lit(5).alias("section"), key.alias("sort"), F.format_string(_POINT, xml_escape(text("tags")), key, text("lon"), text("lat")).alias("value"))
    return _framed(styles.unionByName(places))


def write_kml(parts: DataFrame, path: str) -> None:
    """Part files that make one document when read in order of their names."""
    parts.orderBy("section", "sort", "value").select("value").write.text(path)


def predictions_to_json(predictions: DataFrame, by: str = "id") -> DataFrame:
    """(by, json): the service's answer from rows (by, rank, center, polygon, probability)."""
    row = F.struct("rank", F.struct("center", "polygon", "probability").alias("p"))
    result = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"])
    return predictions.groupBy(by).agg(result.alias("result")).select(by, F.to_json(F.struct(F.lit(200).alias("status"), F.lit("").alias("error"), "result")).alias("json"))


def class_predictions_to_json(predictions: DataFrame, by: str = "id") -> DataFrame:
    """(by, json): a list of lat, lon, confidence, classNum in order of rank."""
    row = F.struct("rank", F.struct("lat", "lon", "confidence", F.col("class_no").alias("classNum")).alias("p"))
    return predictions.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"])).alias("json"))
