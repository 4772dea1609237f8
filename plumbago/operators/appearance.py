"""Parameters of synthetic lines: colours, layout, style, pattern texts. Pure columns of a row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.functions import numeric as n
from plumbago.functions import text as t

#: Weights of colour modes, of pattern texts and of backgrounds, and the share of outlined text.
MODE_WEIGHTS = [5.0, 1.5, 2.5, 1.5, 2.0]
PATTERN_WEIGHTS = [1.0, 1.0, 1.0, 0.5, 0.5]
BACKGROUND_WEIGHTS = [3.0, 2.0, 2.0]
STROKE = 0.10
#: Ranges of the layout.
PAD, NEIGHBOUR_GAP, NEIGHBOUR_VISIBLE, SLACK, PARTIAL = (-0.10, 0.55), (0.08, 0.45), (0.05, 0.50), (0.0, 0.35), (0.5, 0.97)
NEIGHBOUR_P, PARTIAL_P, TILT_P, TILT_SIGMA = 0.35, 0.35, 0.45, 6.0


class Draws:
    """Named uniforms of a row: the same seed, epoch and key give the same draw anywhere."""

    def __init__(self, key: Column, seed: int = 0, epoch: int = 0) -> None:
        self.key, self.seed, self.epoch = key, seed, epoch

    def u(self, name: str) -> Column:
        return n.uniform(self.seed, self.epoch, name, self.key)

    def between(self, name: str, low: float, high: float) -> Column:
        return self.u(name) * (high - low) + low

    def integer(self, name: str, low: int, high: int) -> Column:
        return n.uniform_int(self.u(name), low, high)

    def happens(self, name: str, p: float) -> Column:
        return self.u(name) < p

    def normal(self, name: str, sigma: float) -> Column:
        """Box-Muller on two uniforms."""
        return F.sqrt(-2 * F.log(1 - self.u(name + "/r"))) * F.cos(2 * 3.141592653589793 * self.u(name + "/a")) * sigma


def _gray(level: Column, d: Draws, name: str) -> list[Column]:
    base = F.bround(n.clip(level, 0, 255), 0)
    return [n.clip(base + d.integer(f"{name}/{c}", -6, 6), 0, 255).cast("int") for c in "rgb"]


def _rgb(parts: list[Column]) -> Column:
    return F.struct(*[p.alias(c) for p, c in zip(parts, "rgb")])


def colour_scheme(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds mode, background, foreground (structs r, g, b) and stroke (NULL where there is none)."""
    d = Draws(F.col(key), seed)
    lum = lambda c: n.relative_luminance(*c)
    muted = list(n.hsv_to_rgb(d.u("hue"), d.between("ms", 0.04, 0.30), d.between("mv", 0.45, 1.0)))
    vivid = list(n.hsv_to_rgb(d.u("hue"), d.between("vs", 0.55, 1.0), d.between("vv", 0.45, 1.0)))
    surface = list(n.hsv_to_rgb(d.u("hue"), d.between("ss", 0.0, 0.35), d.between("sv", 0.25, 0.85)))
    mean = (surface[0] + surface[1] + surface[2]) / 3.0
    gap = d.between("gap", 0.12, 0.45) * 255
    pairs = [
        (_gray(d.between("db", 215, 255), d, "db"), _gray(d.between("df", 0, 70), d, "df")),
        (_gray(d.between("ib", 0, 70), d, "ib"), _gray(d.between("if", 200, 255), d, "if")),
        (muted, _gray(F.when(lum(muted) < 0.25, d.between("ml", 190, 255)).otherwise(d.between("mf", 0, 90)), d, "mf")),
        (vivid, _gray(F.when(lum(vivid) < 0.35, d.between("vl", 215, 255)).otherwise(d.between("vf", 0, 55)), d, "vf")),
        (surface, _gray(F.when(mean > 127.5, mean - gap).otherwise(mean + gap), d, "sf")),
    ]
    rows = df.withColumn("mode", n.weighted_pick(d.u("mode"), MODE_WEIGHTS))

    def chosen(which: int) -> Column:
        out = _rgb(pairs[-1][which])
        for i in range(len(pairs) - 2, -1, -1):
            out = F.when(F.col("mode") == i, _rgb(pairs[i][which])).otherwise(out)
        return out

    rows = rows.withColumns({"background": chosen(0), "foreground": chosen(1)})
    dark = n.relative_luminance(F.col("foreground.r"), F.col("foreground.g"), F.col("foreground.b")) < 0.5
    level = F.when(dark, F.lit(255)).otherwise(F.lit(0))
    return rows.withColumn("stroke", F.when(d.happens("stroke", STROKE), F.struct(level.alias("r"), level.alias("g"), level.alias("b"))))


def layout(df: DataFrame, key: str, aspect: str, seed: int = 0) -> DataFrame:
    """Adds padding, neighbours, fill and tilt of a crop; long lines tilt less."""
    d = Draws(F.col(key), seed)
    rows = df.withColumns({
        "pad_top": d.between("pt", *PAD), "pad_bottom": d.between("pb", *PAD), "neighbour_gap": d.between("ng", *NEIGHBOUR_GAP), "neighbour_visible": d.between("nv", *NEIGHBOUR_VISIBLE),
        "slack": d.between("sl", *SLACK), "fill": F.when(d.happens("p?", PARTIAL_P), d.between("pf", *PARTIAL)).otherwise(F.lit(1.0)),
    })
    size = F.least(F.abs(d.normal("tilt", TILT_SIGMA)), n.tilt_ceiling(F.col(aspect)))
    tilt = F.when(d.happens("t?", TILT_P), size * F.when(d.u("sign") < 0.5, 1).otherwise(-1)).otherwise(F.lit(0.0))
    near = lambda pad, name: (F.col(pad) > 0) & d.happens(name, NEIGHBOUR_P)
    return rows.withColumns({"tilt": tilt, "above": near("pad_top", "a?"), "below": near("pad_bottom", "b?")})


def pattern_text(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds pattern (which) and text: dimensions, price, article code, phone number or date."""
    d = Draws(F.col(key), seed)
    sizes = [d.integer(f"d{i}", 3, 400) for i in range(3)]
    parts = F.when(d.integer("dn", 2, 3) == 2, F.array(*sizes[:2])).otherwise(F.array(*sizes))
    separator = F.get(F.array(F.lit("x"), F.lit("*"), F.lit(" x ")), d.integer("sep", 0, 2))
    digits = F.lpad(F.floor(d.u("phone") * 10_000_000_000).cast("string"), 10, "0")
    group = lambda i: F.slice(F.array(*[d.integer(f"g{i}{j}", 0, 259) for j in range(5)]), 1, d.integer(f"gl{i}", 2, 5))
    groups = F.slice(F.array(*[group(i) for i in range(5)]), 1, d.integer("gn", 2, 5))
    kinds = F.array(*[d.happens(f"gk{i}", 0.4) for i in range(5)])
    texts = [
        t.dimensions(separator, parts), t.price(d.integer("amount", 50, 900_000), d.happens("sign", 0.5)), t.article_code(groups, kinds), t.phone(digits),
        t.date_text(d.integer("year", 1990, 2026), d.integer("month", 1, 12), d.integer("day", 1, 28)),
    ]
    rows = df.withColumn("pattern", n.weighted_pick(d.u("pattern"), PATTERN_WEIGHTS))
    out = texts[-1]
    for i in range(len(texts) - 2, -1, -1):
        out = F.when(F.col("pattern") == i, texts[i]).otherwise(out)
    return rows.withColumn("text", out)


def mixed_lines(keys: DataFrame, key: str, sources: list[tuple[DataFrame, str, float]], seed: int = 0) -> DataFrame:
    """A line for every key from weighted sources of numbered lines (number from 0, line column, weight)."""
    d = Draws(F.col(key), seed)
    rows = keys.withColumn("source", n.weighted_pick(d.u("source"), [w for *_, w in sources]))
    out = None
    for i, (lines, column, _) in enumerate(sources):
        size = lines.count()
        drawn = rows.where(F.col("source") == i).withColumn("number", F.floor(d.u("line") * size))
        one = drawn.join(lines.select(F.col("number").cast("long").alias("number"), F.col(column).alias("line")), "number").drop("number")
        out = one if out is None else out.unionByName(one)
    return out


def background_pixels(kind: str, height: int, width: int, colour: tuple[int, int, int], rng) -> "np.ndarray":  # noqa: F821
    """Solid, gradient or grainy pixels of a background colour."""
    import numpy as np

    base = np.array(colour, dtype=np.float32)
    if kind == "solid":
        return np.broadcast_to(base, (height, width, 3)).astype(np.uint8)
    if kind == "gradient":
        end = np.clip(base + int(rng.uniform(20, 90)) * (1 if rng.random() < 0.5 else -1), 0, 255)
        mix = rng.random()
        along = mix * np.linspace(0, 1, width)[None, :] + (1 - mix) * np.linspace(0, 1, height)[:, None]
        return (base + along[..., None] * (end - base)).astype(np.uint8)
    if kind == "noise":
        return (base + rng.normal(0, rng.uniform(4, 28), (height, width, 3))).clip(0, 255).astype(np.uint8)
    raise ValueError(f"unknown background {kind}")


def find_patch(size: tuple[int, int], obstacles: list[tuple[int, int, int, int]], side: int, rng, attempts: int = 24, least: int = 96) -> tuple[int, int, int, int] | None:
    """A square of a photo (width, height) that overlaps no obstacle, or None after the attempts."""
    side = min(side, *size)
    if side < least:
        return None
    for _ in range(attempts):
        x, y = int(rng.integers(0, size[0] - side + 1)), int(rng.integers(0, size[1] - side + 1))
        if not any(x < r and left < x + side and y < b and top < y + side for left, top, r, b in obstacles):
            return x, y, x + side, y + side
    return None
