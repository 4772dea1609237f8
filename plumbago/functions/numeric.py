"""Scalar expressions: probabilities, losses, bins, colour and layout geometry. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of the logarithmic grid, clip of the log loss.
HEIGHT_FLOOR, ASPECT_FLOOR = 8.0, 1.05
LOG_CLIP = 1e-7


def sigmoid(logit: Column, temperature: Column | float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-logit / temperature))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross entropy that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def log_floor(value: Column, floor: float) -> Column:
    return F.log(F.greatest(value, F.lit(floor)))


def bin_of(value: Column, edges: Column, bins: int) -> Column:
    """Bin number from 0: edges at or below the value, less one, kept inside; the last bin is closed."""
    return F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= value)) - 1, F.lit(0)), F.lit(bins - 1))


def lcg_uniform(key: Column, seed: int = 12345) -> Column:
    """A uniform in [0, 1) from an integer key, expressible in any SQL."""
    return F.pmod(key * F.lit(1103515245) + F.lit(seed), F.lit(2147483648)) / F.lit(2147483648.0)


def uniform(seed: int, epoch: int, stream: str, *key: Column) -> Column:
    """A 53-bit uniform in [0, 1), a pure function of seed, epoch, stream and key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(stream), *key), 11) / F.lit(float(1 << 53))


def uniform_int(u: Column, low: int, high: int) -> Column:
    """An integer in the closed range from a uniform."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def weighted_pick(u: Column, weights: list[float]) -> Column:
    """Index of a categorical draw: cumulative thresholds on one uniform; zero weights are never drawn."""
    total = float(sum(weights))
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must not be negative and must not all be zero")
    drawn = [(i, w) for i, w in enumerate(weights) if w > 0]
    out, below = F.lit(drawn[-1][0]), total - drawn[-1][1]
    for i, w in reversed(drawn[:-1]):
        out = F.when(u * total < below, F.lit(i)).otherwise(out)
        below -= w
    return out


def inverse_cdf(u: Column, quantiles: Column, steps: int = 100) -> Column:
    """Draw from equally spaced quantiles (steps + 1 of them) by linear interpolation."""
    at = F.least(F.floor(u * steps), F.lit(steps - 1)).cast("int")
    low, high = F.get(quantiles, at), F.get(quantiles, at + 1)
    return low + (high - low) * (u * steps - at)


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB channels 0..255 (WCAG 2.1)."""
    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_ratio(first: Column, second: Column) -> Column:
    """Contrast of two luminances."""
    return (F.greatest(first, second) + 0.05) / (F.least(first, second) + 0.05)


def hsv_to_rgb(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """Channels 0..255, rounded half to even, from hue, saturation and value in 0..1."""
    sector = F.pmod(F.floor(hue * 6), F.lit(6))
    f = hue * 6 - F.floor(hue * 6)
    p, q, t = value * (1 - saturation), value * (1 - saturation * f), value * (1 - saturation * (1 - f))

    def ladder(*options: Column) -> Column:
        out = F.when(sector == 0, options[0])
        for i, o in enumerate(options[1:], 1):
            out = out.when(sector == i, o)
        return clip(F.bround(out * 255, 0), 0, 255).cast("int")

    return ladder(value, q, p, p, t, value), ladder(t, value, value, q, p, p), ladder(p, p, t, value, value, q)


def tilt_ceiling(aspect: Column, max_tilt: float = 18.0, max_growth: float = 2.0) -> Column:
    """Largest tilt in degrees at which a box grows no more than allowed."""
    sine = (max_growth - 1.0) / F.greatest(aspect, F.lit(1.0))
    return F.when(sine >= 1.0, F.lit(max_tilt)).otherwise(F.least(F.lit(max_tilt), F.degrees(F.asin(F.least(sine, F.lit(1.0))))))


def tilt_compensation(tilt: Column, aspect: Column, most: float = 1.5) -> Column:
    """How much longer a tilted line must be for its box to have the wanted aspect."""
    a = F.abs(F.radians(tilt))
    below = F.cos(a) - aspect * F.sin(a)
    return F.when(below <= 0, F.lit(most)).otherwise(clip((aspect * F.cos(a) - F.sin(a)) / below / aspect, 1.0, most))


def target_width(width: Column, height: Column, target_height: int) -> Column:
    """Width after scaling to a height: at least 1, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(width * target_height / height, 0).cast("int"))


def learning_rate(step: Column, total: int, warm_up: int, peak: float) -> Column:
    """Linear warm-up, then a cosine to zero (for reports)."""
    done = (step - warm_up) / F.lit(float(max(1, total - warm_up)))
    return F.when(step < warm_up, peak * (step + 1) / float(max(1, warm_up))).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(done, F.lit(1.0)))))
