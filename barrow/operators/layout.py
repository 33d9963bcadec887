"""Page layout: boxes, lines, captions and tables that go on over a page break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def text_lines(words: DataFrame, step: float = 20.0) -> DataFrame:
    """SRT-04, AGG-15: words(page, x1, y1, x2, y2, word) as lines: (page, line_y, text, x1, y1, x2, y2), words from left to right."""
    line = F.bround(F.col("y1") / step).cast("int") * int(step)
    ordered = F.sort_array(F.collect_list(F.struct("x1", "word")))
    return words.groupBy("page", line.alias("line_y")).agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def sections_of_blocks(blocks: DataFrame, headers: DataFrame, reach: float = 200.0) -> DataFrame:
    """JOI-09: the header of each block: (page, block_id, section).

    Of the headers that overlap the block in height the horizontally nearest; else the nearest above within reach; else
    UNKNOWN. Pages are the join key, the rest is a range test within a page.
    """
    both = blocks.alias("b").join(headers.alias("h"), F.col("b.page") == F.col("h.page"), "left")
    overlap = ~((F.col("h.y2") < F.col("b.y1")) | (F.col("h.y1") > F.col("b.y2")))
    side = F.greatest(F.lit(0.0), F.col("h.x1") - F.col("b.x2"), F.col("b.x1") - F.col("h.x2"))
    above = F.col("b.y1") - F.col("h.y2")
    rank = F.when(overlap, F.struct(F.lit(0).alias("k"), side.cast("double").alias("d"))).when((above >= 0) & (above <= reach), F.struct(F.lit(1).alias("k"), above.cast("double").alias("d")))
    scored = both.select(F.col("b.page").alias("page"), F.col("b.block_id").alias("block_id"), F.col("h.section").alias("section"), rank.alias("rank"))
    best = scored.groupBy("page", "block_id").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "section"))).alias("m"))
    return best.select("page", "block_id", F.coalesce("m.section", F.lit("UNKNOWN")).alias("section"))


def captions_of_images(images: DataFrame, captions: DataFrame, share: float = 0.3, reach: float = 400.0) -> DataFrame:
    """JOI-10: the nearest caption below each image that covers `share` of its width: (page, image_id, caption_id)."""
    both = images.alias("i").join(captions.alias("c"), F.col("i.page") == F.col("c.page"))
    across = F.least(F.col("i.x2"), F.col("c.x2")) - F.greatest(F.col("i.x1"), F.col("c.x1"))
    gap = F.col("c.y1") - F.col("i.y2")
    good = both.where((gap >= 0) & (gap < reach) & (across >= share * (F.col("i.x2") - F.col("i.x1"))))
    return good.groupBy(F.col("i.page").alias("page"), F.col("i.image_id").alias("image_id")).agg(F.min(F.struct(gap.alias("gap"), F.col("c.caption_id"))).alias("m")).select("page", "image_id", "m.caption_id")


def continued_tables(tables: DataFrame, doc: str, page: str, first: str, last: str) -> DataFrame:
    """JOI-11: tables that go on: each table's run number, a new run where the numbering does not go on from the page before."""
    w = Window.partitionBy(doc).orderBy(page, first)
    goes_on = F.col(first) == F.lag(last).over(w) + 1
    return tables.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best_boxes(boxes: DataFrame, keys: list[str], score: str, columns: list[str]) -> DataFrame:
    """LIM-06: the box of the highest score for each key, ties to the smallest columns."""
    picked = F.min(F.struct(F.negate(score).alias("_s"), *columns)).alias("m")
    return boxes.where(F.col(score).isNotNull()).groupBy(*keys).agg(picked).select(*keys, F.negate("m._s").alias(score), *[f"m.{c}" for c in columns])


def reading_order(boxes: DataFrame) -> DataFrame:
    """SRT-03: boxes(page, box_id, x, y, h) in reading order: by y, then one pass that swaps neighbours on one line."""

    def order(pdf):
        rows = pdf.sort_values(["y", "x", "box_id"]).to_dict("records")
        for i in range(len(rows) - 1):
            a, b = rows[i], rows[i + 1]
            if b["y"] < a["y"] + a["h"] and b["x"] < a["x"]:
                rows[i], rows[i + 1] = b, a
        out = pdf.iloc[:0].copy()
        out = type(pdf)(rows)
        out["place"] = range(1, len(rows) + 1)
        return out[["page", "box_id", "place"]]

    return boxes.groupBy("page").applyInPandas(order, "page long, box_id long, place int")


def companions(pdfs: DataFrame, kmls: DataFrame) -> DataFrame:
    """JOI-12, JOI-13: the KML of each PDF by path: same folder and stem first, then the parent's same stem, then any KML in the folder."""

    def stem(path):
        return F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]+$", ""))

    def folder(path):
        return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)

    left = pdfs.select(F.col("path").alias("pdf"), stem(F.col("path")).alias("stem"), folder(F.col("path")).alias("dir"))
    keys = F.array(F.struct(F.lit(1).alias("rank"), F.concat_ws("|", "dir", "stem").alias("k")), F.struct(F.lit(2).alias("rank"), F.concat_ws("|", folder(F.col("dir")), F.col("stem")).alias("k")), F.struct(F.lit(3).alias("rank"), F.col("dir").alias("k")))
    wanted = left.select("pdf", F.inline(keys))
    right = kmls.select(F.col("path").alias("kml"), stem(F.col("path")).alias("stem"), folder(F.col("path")).alias("dir"))
    offered = right.select("kml", F.explode(F.array(F.concat_ws("|", "dir", "stem"), F.col("dir"))).alias("k"))
    return wanted.join(offered, "k").groupBy("pdf").agg(F.min(F.struct("rank", "kml")).alias("m")).select("pdf", "m.kml")


def companions_by_part(pdfs: DataFrame, kmls: DataFrame) -> DataFrame:
    """JOI-13: PDFs with the first KML of their folder whose stem holds theirs, or is held by it: (pdf, kml)."""
    stem = lambda path: F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]+$", ""))
    folder = lambda path: F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    left = pdfs.select(F.col("path").alias("pdf"), stem(F.col("path")).alias("a"), folder(F.col("path")).alias("dir"))
    right = kmls.select(F.col("path").alias("kml"), stem(F.col("path")).alias("b"), folder(F.col("path")).alias("dir"))
    both = left.join(right, "dir").where(F.contains("a", F.col("b")) | F.contains("b", F.col("a")))
    return both.groupBy("pdf").agg(F.min("kml").alias("kml"))
