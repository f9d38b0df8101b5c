"""Pages of a document: orientation, geometry, validation and pages of results."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import pdf
from framewright.functions.text import clock, content_name, plain, truncate, wrapped
from framewright.params import DEFAULT, Params

#: Page sizes in millimetres (fixed values).
PAGES = {"A4": (210.0, 297.0), "LETTER": (215.9, 279.4)}


def points(mm: float) -> float:
    return mm * 72.0 / 25.4


def orientation(w: Column, h: Column, p: Params = DEFAULT) -> Column:
    r = w / h
    return F.when(F.abs(r - 1.0) <= p.square_tolerance, "SQUARE").when(r > 1.0, "LANDSCAPE").otherwise("PORTRAIT")


def page_layout(items: DataFrame, p: Params = DEFAULT, size: str = "A4", square: str = "PORTRAIT", upscale: bool = False) -> DataFrame:
    """Where everything stands on the page of each item (order, width, height), in points."""
    side = F.when(F.col("orientation") == "SQUARE", square).otherwise(F.col("orientation"))
    w, h = (points(x) for x in PAGES[size])
    m = points(p.margin_mm)
    head, foot, cap = (points(mm) if on else 0.0 for mm, on in ((p.header_mm, p.header_enabled), (p.footer_mm, p.footer_enabled), (p.caption_mm, p.caption_enabled)))
    x = items.withColumn("orientation", orientation(F.col("width"), F.col("height"), p)).withColumn("page_orientation", side)
    wide = F.col("page_orientation") == "LANDSCAPE"
    x = x.withColumn("page_width", F.when(wide, F.lit(h)).otherwise(F.lit(w))).withColumn("page_height", F.when(wide, F.lit(w)).otherwise(F.lit(h)))
    uw, uh = F.col("page_width") - 2 * m, F.col("page_height") - 2 * m - head - foot - cap
    scale = F.least(uw / F.col("width"), uh / F.col("height"))
    x = x.withColumns({"usable_width": uw, "usable_height": uh}).withColumn("scale", scale if upscale else F.least(scale, F.lit(1.0)))
    x = x.withColumns({"image_width": F.col("width") * F.col("scale"), "image_height": F.col("height") * F.col("scale")})
    return x.withColumns({
        "image_x": m + (F.col("usable_width") - F.col("image_width")) / 2.0, "image_y": m + head + (F.col("usable_height") - F.col("image_height")) / 2.0,
        "caption_y": F.when(F.lit(cap > 0), m + head + F.col("usable_height")), "footer_y": F.when(F.lit(foot > 0), F.col("page_height") - m - foot), "utilization": F.col("image_width") * F.col("image_height") / (F.col("usable_width") * F.col("usable_height")),
    })


def layout_problems(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pages that break a rule: out of bounds, distorted, enlarged, or numbered with a hole."""
    e = p.layout_epsilon
    out = (F.col("image_x") < -e) | (F.col("image_y") < -e) | (F.col("image_x") + F.col("image_width") > F.col("page_width") + e) | (F.col("image_y") + F.col("image_height") > F.col("page_height") + e)
    bent = F.abs(F.col("image_width") / F.col("image_height") - F.col("width") / F.col("height")) > 1e-6
    return pages.withColumn("problem", F.when(out, "OUT_OF_BOUNDS").when(bent, "ASPECT_CHANGED").when(F.col("scale") > 1.0 + 1e-9, "UPSCALED")).where("problem is not null")


def layout_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("job_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("page_orientation") == "PORTRAIT").alias("portrait_pages"), F.count_if(F.col("page_orientation") == "LANDSCAPE").alias("landscape_pages"), F.avg("scale").alias("mean_scale"), F.min("scale").alias("min_scale"), F.avg("utilization").alias("mean_utilization"), F.percentile("utilization", F.lit(0.5)).alias("median_utilization"), F.countDistinct("width", "height").alias("resolutions"))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50, most: int = 100) -> DataFrame:
    """A page of results."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def render_plan(pages: DataFrame, p: Params = DEFAULT, size: float = 9.0, lines: int = 3, title_size: float = 9.0, title_characters: int = 120, number_of: bool = True) -> DataFrame:
    """What is written on each page, with its boxes.

    ``pages`` has page_layout's columns and page_number, timestamp_seconds, content_type, snippet and title.  The caption is
    the time and the kind of content, and after a dash the snippet; it is cut by words and then wrapped to its box.
    """
    m, width = points(p.margin_mm), F.col("page_width") - 2 * points(p.margin_mm)
    head = F.concat_ws(" · ", clock(F.col("timestamp_seconds")), content_name(F.col("content_type")))
    body = plain(F.col("snippet"))
    whole = F.when(F.length(body) > 0, F.concat_ws(" — ", head, body)).otherwise(head)
    pages = pages.withColumn("_whole", whole).withColumn("_caption", truncate(F.col("_whole"), p.caption_max_characters, p.caption_max_words)).withColumn("_title", F.substring(plain(F.col("title")), 1, title_characters))
    # boxes are as wide as the page is: one expression for each of the two ways that a page can lie
    widths = sorted({side - 2 * m for side in (points(x) for x in PAGES["A4"])})
    one = lambda c, s, n: F.when(F.abs(width - widths[0]) < 1.0, wrapped(c, widths[0], s, n)).otherwise(wrapped(c, widths[1], s, n))
    total = F.count("*").over(Window.partitionBy("job_id"))
    number = F.col("page_number").cast("string")
    x = pages.withColumns({"caption": one(F.col("_caption"), size, lines), "header": one(F.col("_title"), title_size, 1), "footer_text": F.concat_ws(" / ", number, total.cast("string")) if number_of else number})
    box = lambda y, mm: F.struct(F.lit(m).alias("x"), y.alias("y"), width.alias("width"), F.lit(points(mm)).alias("height"))
    x = x.withColumns({"caption_text": F.col("caption.text"), "caption_cut": F.col("caption.cut") | (F.col("_caption") != F.col("_whole")), "header_text": F.col("header.text")})
    return x.withColumns({"caption_box": box(F.col("caption_y"), p.caption_mm), "footer_box": box(F.col("footer_y"), p.footer_mm)}).drop("caption", "header", "_caption", "_whole", "_title")


def pdf_files(plan: DataFrame, images: DataFrame, title: str = "Lecture Notes") -> DataFrame:
    """(job_id, pages, bytes, sha256, content, error): a PDF for each job, from its render plan and its pictures.

    ``images`` has (job_id, candidate_id, pixels, columns, rows, sha256); a picture whose digest is not the planned one
    (file_sha256) makes the job's file an error.  A job has a thousand pages at most, which one task holds.
    """

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {r["candidate_id"]: r for r in right.to_dict("records")}
        try:
            pages = []
            for r in left.sort_values("page_number").to_dict("records"):
                i = held.get(r["candidate_id"])
                if i is None or i["sha256"] != r["file_sha256"]:
                    raise ValueError(f"the picture of page {r['page_number']} is not the planned one")
                texts = [pdf.Text(r["caption_text"], **r["caption_box"], size=9.0), pdf.Text(r["footer_text"], **r["footer_box"], size=8.0, align="CENTER")]
                pages.append(pdf.Page(r["page_width"], r["page_height"], i["pixels"], int(i["columns"]), int(i["rows"]), (r["image_x"], r["image_y"], r["image_width"], r["image_height"]), texts))
            data = pdf.write(pages, title)
            row = (key[0], len(pages), len(data), hashlib.sha256(data).hexdigest(), data, None)
        except ValueError as e:
            row = (key[0], 0, 0, None, None, str(e))
        return pd.DataFrame([row], columns=["job_id", "pages", "bytes", "sha256", "content", "error"])

    p = plan.select("job_id", "page_number", "candidate_id", "file_sha256", "page_width", "page_height", "image_x", "image_y", "image_width", "image_height", "caption_text", "caption_box", "footer_text", "footer_box")
    i = images.select("job_id", "candidate_id", "pixels", "columns", "rows", "sha256")
    return p.groupBy("job_id").cogroup(i.groupBy("job_id")).applyInPandas(one, "job_id string, pages int, bytes bigint, sha256 string, content binary, error string")
