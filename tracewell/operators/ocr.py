"""Recorded OCR detections to one text per image: box filter, weighted scores, language ranking and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import chunk_starts, dedupe_words, preview, scripts, strip, utility

# Least score of a box, least area (absolute, and of the image), score of the first language that ends the search,
# least score and length for a fusion, side and overlap of tiles.
BOX_SCORE, BOX_AREA, BOX_SHARE, FAST_SCORE, FUSE_SCORE, FUSE_LENGTH, SIDE, OVERLAP = 0.90, 150.0, 3e-5, 0.95, 0.80, 16, 3200, 160
#: Languages in the order in which they are tried.
LANGUAGES = (
    "ch", "hu", "en", "rs_latin", "fr", "id", "de", "oc", "japan", "is", "korean", "lt", "chinese_cht", "mi", "af",
    "ms", "it", "nl", "es", "no", "bs", "pl", "pt", "sk", "cs", "sl", "cy", "sq", "da", "sv",
    "et", "sw", "ga", "tl", "hr", "tr", "uz", "la", "ru", "be", "uk", "th", "el",
)


def polygon_area(poly: Column) -> Column:
    """Shoelace area of an array of (x, y); 0 for fewer than three points, null for null.

    Boxes of four points are plain arithmetic, which is compiled; others go through array functions.
    """
    n = F.size(poly)
    x, y = (lambda i: F.get(poly, F.lit(i))["x"]), (lambda i: F.get(poly, F.lit(i))["y"])
    # of four points: half the cross product of the diagonals
    four = (x(2) - x(0)) * (y(3) - y(1)) - (x(3) - x(1)) * (y(2) - y(0))
    cross = F.transform(poly, lambda p, i: p["x"] * F.get(poly, (i + 1) % n)["y"] - F.get(poly, (i + 1) % n)["x"] * p["y"])
    other = F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)
    return F.when(n == 4, F.abs(four) / 2).when(n >= 3, F.abs(other) / 2).when(poly.isNotNull(), F.lit(0.0))


def tiles(df: DataFrame, key: str, w: str, h: str, side: int = SIDE, overlap: int = OVERLAP) -> DataFrame:
    """(key, tile from 0, x0, y0, x1, y1): overlapping tiles of an image, columns of tiles first; one for an image within ``side``."""
    cut = lambda n, name: F.transform(chunk_starts(n, side, overlap), lambda s: F.struct(s.alias("a"), F.least(s + side, n).alias("b")))
    rows = df.select(key, F.col(w).alias("w"), F.col(h).alias("h"))
    rows = rows.select(key, "h", F.posexplode(cut(F.col("w"), "x")).alias("i", "x"))
    rows = rows.select(key, "i", "x", F.size(cut(F.col("h"), "y")).alias("ny"), F.posexplode(cut(F.col("h"), "y")).alias("j", "y"))
    return rows.select(key, (F.col("i") * F.col("ny") + F.col("j")).alias("tile"), F.col("x.a").alias("x0"), F.col("y.a").alias("y0"), F.col("x.b").alias("x1"), F.col("y.b").alias("y1"))


def good_boxes(df: DataFrame) -> DataFrame:
    """Detections with text, a score of at least BOX_SCORE (null counts as 0) and, where there is a polygon, enough area."""
    area = polygon_area(F.col("poly"))
    least = F.greatest(F.lit(BOX_AREA), F.col("img_h") * F.col("img_w") * F.lit(BOX_SHARE))
    big = F.col("poly").isNull() | (area >= least)
    return df.filter((F.coalesce(F.col("text"), F.lit("")) != "") & (F.coalesce(F.col("score"), F.lit(0.0)) >= BOX_SCORE) & big)


def _joined(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Texts joined by a space in order, and the mean score weighted by length."""
    size = F.char_length("text")
    lists = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    out = df.groupBy(*keys).agg(lists.alias("l"), (F.sum(F.col("score") * size) / F.greatest(F.lit(1), F.sum(size))).alias("score"))
    return out.select(*keys, strip(F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("text"), "score")


def language_texts(boxes: DataFrame) -> DataFrame:
    """(image_name, lang, text, score) of good boxes: over the boxes of a tile, then over an image's tiles.

    Boxes are parted by image one time; both groupings, and later ones by image, then need no exchange.  An image's boxes are few.
    """
    per_tile = _joined(boxes.repartition("image_name"), ["image_name", "lang", "tile"], "box").filter("text <> ''")
    return _joined(per_tile, ["image_name", "lang"], "tile")


def _lang_order() -> Column:
    return F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang"))


def ranked_languages(texts: DataFrame) -> DataFrame:
    """``texts`` with ``utility`` and ``rank`` inside the image; ties in the order of LANGUAGES."""
    out = texts.withColumn("utility", utility(F.col("score"), F.col("text")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("image_name").orderBy(F.desc("utility"), _lang_order(), "lang")))


def fuse(texts: DataFrame) -> DataFrame:
    """(image_name, extracted_text, langs) from one text per image and language.

    ``ch`` with FAST_SCORE is taken at once.  Else the best by utility; joined with the second, words de-duplicated, if their
    scripts differ and both have score and length enough.  Images without any usable text give the empty text.
    """
    clean = texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    row = F.struct(utility(F.col("score"), F.col("text")).alias("u"), (-_lang_order()).alias("o"), "lang", "text", "score")
    # at most as many rows per image as there are languages
    lists = clean.groupBy("image_name").agg(F.sort_array(F.collect_list(row), asc=False).alias("l"), F.max(F.when((F.col("lang") == "ch") & (F.col("score") >= FAST_SCORE), F.col("text"))).alias("fast"))
    a, b = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    fit = lambda x: (x["score"] >= FUSE_SCORE) & (F.char_length(x["text"]) >= FUSE_LENGTH)
    both = F.coalesce((F.size("l") > 1) & fit(a) & fit(b) & ~F.arrays_overlap(scripts(a["text"]), scripts(b["text"])), F.lit(False))
    void = (a["text"] == "") & (a["score"] <= 0)
    text = F.when(F.col("fast").isNotNull(), F.col("fast")).when(void, "").when(both, dedupe_words(F.concat(a["text"], F.lit(" "), b["text"]))).otherwise(a["text"])
    langs = F.when(F.col("fast").isNotNull(), F.array(F.lit("ch"))).when(void, F.array().cast("array<string>")).when(both, F.array(a["lang"], b["lang"])).otherwise(F.array(a["lang"]))
    return lists.select("image_name", text.alias("extracted_text"), langs.alias("langs"))


def audit(texts: DataFrame, most: int = 8) -> DataFrame:
    """(image_name, audit): score and preview of the first ``most`` languages tried."""
    row = F.struct(_lang_order().alias("o"), "lang", "score", preview(F.col("text")).alias("preview"))
    lists = texts.groupBy("image_name").agg(F.array_sort(F.collect_list(row)).alias("l"))
    return lists.select("image_name", F.slice("l", 1, most).alias("audit"))
