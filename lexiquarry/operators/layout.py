"""Reading order of pages made of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .lookup import recurring

_START = r"^\d+\s*[.)]"


def pages(blocks: DataFrame) -> DataFrame:
    """Text of each page of ``blocks`` (doc, page, ord, y0, kind, text, xref).

    Text blocks and a marker for each picture stand in order of y0 (ord at ties). Pictures that
    recur on another page of the document, or stand above the page's first question, are left out.
    """
    blocks = blocks.where((F.col("kind") == "image") | (F.trim("text") != ""))
    template = recurring(blocks.where("kind = 'image'").withColumn("_image", F.struct("doc", "xref")), xref="_image").select(F.col("_image.doc").alias("doc"), F.col("_image.xref").alias("xref"))
    begin = F.coalesce(F.min(F.when((F.col("kind") == "text") & F.trim("text").rlike(_START), F.col("y0"))), F.lit(0.0))
    start = blocks.groupBy("doc", "page").agg(begin.alias("begin"))
    images = blocks.where("kind = 'image'").join(template, ["doc", "xref"], "left_anti").join(start, ["doc", "page"]).where("y0 >= begin")
    entries = blocks.where("kind = 'text'").select("doc", "page", "y0", "ord", F.trim("text").alias("line")).unionByName(images.select("doc", "page", "y0", F.col("ord"), F.lit(fixed.DIAGRAM_MARKER).alias("line")))
    ordered = F.array_sort(F.collect_list(F.struct("y0", "ord", "line")))
    return entries.groupBy("doc", "page").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
