"""Picking rows and parts of texts: specs, paths, quotas, exact draws, fitting texts and plain descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.functions.numeric import clip

#: The length a repeated text never passes, and the limits of a canvas's ink.
LONGEST_TEXT, INK_SHARE = 400, (0.2, 1.0)


def spec_parts(spec: Column, least: int, most: int) -> Column:
    """Parts of ``a:b:c``; NULL where there are fewer or more than allowed or one is empty."""
    parts = F.split(spec, ":")
    return F.when(F.size(parts).between(least, most) & ~F.exists(parts, lambda p: p == ""), parts)


def css_addresses(sheet: Column) -> Column:
    """All addresses of a style sheet's ``url(...)``, without quotes, in order."""
    return F.regexp_extract_all(sheet, F.lit(r"url\(\s*['\"]?([^'\")\s]+)['\"]?\s*\)"), F.lit(1))


def image_path(folder: str, image: Column) -> Column:
    """Where an image lies: by its id, whatever name the annotation gives."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), image.cast("string"), F.lit(".jpg"))


def duration_text(seconds: Column) -> Column:
    """``h:mm:ss`` from an hour on, else ``m:ss``."""
    s = F.floor(seconds)
    tail = F.lpad((s % 60).cast("string"), 2, "0")
    minutes = F.floor(s / 60)
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad((minutes % 60).cast("string"), 2, "0"), tail)).otherwise(F.concat_ws(":", minutes.cast("string"), tail))


def describe_score(score: Column, accuracy: Column, rows: Column) -> Column:
    """A line for people: score, accuracy and rows."""
    return F.format_string("score %.4f, accuracy %.2f %%, %d rows", score, accuracy * 100, rows)


def model_megabytes(parameters: Column, bytes_each: int = 4) -> Column:
    return parameters * bytes_each / F.lit(float(1 << 20))


def convolution_macs(height: Column, width: Column, inputs: Column, outputs: Column, kernel: int, separable: bool = False) -> Column:
    """Multiply-accumulates of a convolution over an output plane, dense or depthwise and pointwise."""
    each = inputs * kernel * kernel + inputs * outputs if separable else inputs * outputs * kernel * kernel
    return height * width * each


def ink_ratio(canvas: Column, ink: Column) -> Column:
    """Height of a canvas over that of its ink, which counts as one pixel at least."""
    return canvas / F.greatest(ink, F.lit(1))


def font_size(wanted: Column, ratio: Column, least: int = 8, most: int = 256) -> Column:
    return clip(F.bround(wanted * ratio, 0), least, most).cast("int")


def canvas_size(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Whole pixels of a layout: a box and its paddings as shares of its height."""
    return F.struct(F.ceil(width + (left + right) * height).cast("int").alias("width"), F.ceil(height * (1 + top + bottom)).cast("int").alias("height"))


def prefix_that_fits(text: Column, widths: Column, budget: Column) -> Column:
    """The longest prefix whose characters' widths sum to no more than the budget (widths are not negative)."""
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(a: Column, w: Column) -> Column:
        fits = a["open"] & (a["used"] + w <= budget)
        return F.struct((a["used"] + w).alias("used"), (a["taken"] + fits.cast("int")).alias("taken"), fits.alias("open"))

    return F.substring(text, F.lit(1), F.aggregate(widths, start, step, lambda a: a["taken"]))


def repeat_until(text: Column, width: Column, wanted: Column, gap: float = 0.0, longest: int = LONGEST_TEXT) -> Column:
    """A text joined to itself by spaces until it is as wide as wanted, but never past ``longest`` characters (once at least)."""
    n = F.char_length(text)
    needed = F.ceil((wanted + gap) / F.greatest(width + gap, F.lit(1e-9)))
    room = F.floor((F.lit(longest) + 1) / (n + 1))
    times = F.greatest(F.least(needed, room), F.lit(1)).cast("int")
    return F.rtrim(F.repeat(F.concat(text, F.lit(" ")), times))


def without(df: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among those taken: names chosen before, files and manifests that exist."""
    return df.join(taken.select(*on).distinct(), on, "left_anti")


def quota(df: DataFrame, wanted: Column, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` rows, in an order, that are wanted (a top-k: no whole sort)."""
    return df.where(wanted).orderBy(*order).limit(limit)


def listed(images: DataFrame, annotations: DataFrame, ids: str = "ann_ids", key: str = "ann_id") -> DataFrame:
    """Annotations an image lists, with their place in the list; an id without an annotation gives no row."""
    return images.select(*[c for c in images.columns if c != ids], F.posexplode(ids).alias("place", key)).join(annotations, key)


def truth_by_place(predictions: DataFrame, truth: DataFrame, by: str, place: str) -> DataFrame:
    """Predictions beside the truth of the same place of the same slice."""
    return predictions.join(truth, [by, place])


def member_logits(df: DataFrame, members: dict[str, Column]) -> DataFrame:
    """All members' logits from one scan, for members that read the same geometry."""
    return df.withColumns(members)


def exact_draws(rows: DataFrame, cells: DataFrame, draws: DataFrame, cell: list[str], key: str, salts: int = 64) -> DataFrame:
    """One row for each draw (draw, u): with replacement, by the probability ``p`` of a row of each cell (cells hold n).

    A draw's uniform finds its cell among the cells' shares (a table of at most bins squared rows), and what is
    left of it the row. Rows of a cell are numbered in salted groups with sums of the groups before, so that no
    cell is sorted in one task.
    """
    share = F.col("p") * F.col("n")
    order = Window.orderBy(*cell)
    bounds = cells.where("p > 0").select(*cell, "n", share.alias("share"), F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("high"), F.lead("n").over(order).isNull().alias("last"))
    at = (F.col("u") >= F.col("high") - F.col("share")) & ((F.col("u") < F.col("high")) | F.col("last"))
    inside = F.least(F.greatest(F.floor((F.col("u") - (F.col("high") - F.col("share"))) / F.col("share") * F.col("n")), F.lit(0)), F.col("n") - 1)
    placed = draws.join(F.broadcast(bounds), at).select("draw", *cell, inside.cast("long").alias("number"))
    salted = rows.withColumn("salt", F.pmod(F.col(key), F.lit(salts)))
    before = salted.groupBy(*cell, "salt").agg(F.count(F.lit(1)).alias("of_salt"))
    before = before.withColumn("before", F.coalesce(F.sum("of_salt").over(Window.partitionBy(*cell).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*cell, "salt").orderBy(key)) - 1)
    numbered = numbered.join(F.broadcast(before.drop("of_salt")), [*cell, "salt"]).withColumn("number", F.col("before") + F.col("rank"))  # at most bins squared times salts
    return placed.join(numbered.drop("salt", "rank", "before"), [*cell, "number"])
