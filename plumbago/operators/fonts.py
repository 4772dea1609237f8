"""Font coverage and line style, without a rasteriser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.operators.appearance import Draws

#: The share of an alphabet a font must have, and the alphabets.
LEAST_COVERAGE = 0.98
LATIN = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]
CYRILLIC = [0x401, 0x451, *range(0x410, 0x450)]
DIGITS = list(range(ord("0"), ord("9") + 1))
#: Probability and range of letter spacing, forward slant and outline width.
SPACING, SKEW, OUTLINE = (0.25, -0.02, 0.25), (0.20, 3.0, 22.0), (0.15, 1, 3)


def coverage_share(ranges: Column, points: list[int]) -> Column:
    """Share of code points inside the ranges (lo, hi); 0 for no points."""
    if not points:
        return F.lit(0.0)
    held = F.filter(F.array(*[F.lit(p) for p in points]), lambda p: F.exists(ranges, lambda r: p.between(r["lo"], r["hi"])))
    return F.size(held) / F.lit(float(len(points)))


def eligible(fonts: DataFrame, coverage: str = "coverage") -> DataFrame:
    """Fonts with the digits and at least one whole alphabet, and the scripts they can write."""
    ok = lambda points: coverage_share(F.col(coverage), points) >= LEAST_COVERAGE
    scripts = F.filter(F.array(F.when(ok(CYRILLIC), "cyrillic"), F.when(ok(LATIN), "latin")), lambda s: s.isNotNull())
    return fonts.withColumn("scripts", scripts).where(ok(DIGITS) & (F.size("scripts") > 0))


def line_style(df: DataFrame, key: str, stroke: str = "stroke", seed: int = 0) -> DataFrame:
    """Adds letter spacing, slant (forward only, as italics are) and outline width (0 without a stroke colour)."""
    d = Draws(F.col(key), seed)
    pick = lambda name, spec: F.when(d.happens(name + "?", spec[0]), d.between(name, *spec[1:])).otherwise(F.lit(0.0))
    width = F.when(F.col(stroke).isNotNull() & d.happens("outline?", OUTLINE[0]), d.integer("outline", *OUTLINE[1:])).otherwise(F.lit(0))
    return df.withColumns({"letter_spacing": pick("spacing", SPACING), "skew": pick("skew", SKEW), "stroke_width": width})
