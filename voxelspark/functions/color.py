"""8-bit colour arithmetic on plain integer channel columns.

A colour is an :class:`Rgba` of four int columns, so every channel stays inside
whole-stage code generation. ``store``/``load`` move it in and out of a struct.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import col


class Rgba(NamedTuple):
    r: Column
    g: Column
    b: Column
    a: Column

    def map(self, fn) -> "Rgba":
        """Apply ``fn`` to the three colour channels, leaving alpha alone."""
        return Rgba(fn(self.r), fn(self.g), fn(self.b), self.a)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(prefix + n) for n, c in zip("rgba", self)]

    def struct(self) -> Column:
        return F.struct(*self.columns())


# Default colours and the ramps of the thematic styles.
UNEXPLORED = (0x14, 0x16, 0x1A, 255)
PLAIN_WATER = (0x3F, 0x76, 0xE4, 255)
CONTOUR_MINOR = (0x4A, 0x33, 0x20, 0x9B)
CONTOUR_MAJOR = (0x6B, 0x48, 0x28, 0xE6)
LIGHT_DARK = (0xE0, 0x3B, 0x3B, 255)
LIGHT_CAUTION = ((0xE8, 0x8A, 0x2A, 255), (0xE8, 0xD0, 0x44, 255))
LIGHT_SAFE = ((0x2F, 0x6D, 0x4A, 255), (0x54, 0xC9, 0x82, 255))
HEIGHT_RAMP = (
    (0x0B, 0x1B, 0x3A, 255),
    (0x1C, 0x4C, 0x6B, 255),
    (0x2E, 0x7D, 0x63, 255),
    (0x74, 0xA5, 0x44, 255),
    (0xC7, 0xB8, 0x56, 255),
    (0x9C, 0x6F, 0x45, 255),
    (0xF2, 0xF4, 0xF7, 255),
)
ORE_COLORS = (
    (0x1B, 0x1E, 0x24, 255),
    (0xA8, 0x8C, 0xC0, 255),
    (0x3D, 0x43, 0x4D, 255),
    (0xC8, 0x7B, 0x4A, 255),
    (0xD8, 0xB0, 0x8C, 255),
    (0x2C, 0x5A, 0xC4, 255),
    (0xD0, 0x2A, 0x2A, 255),
    (0xF0, 0xC2, 0x3A, 255),
    (0x2C, 0xD4, 0x6A, 255),
    (0x4D, 0xE0, 0xDC, 255),
    (0x7A, 0x4A, 0x3C, 255),
)
ORE_FULL_SCORE = 16.0


def rgba(values) -> Rgba:
    return Rgba(*[F.lit(int(v)) for v in values])


def load(struct) -> Rgba:
    s = col(struct)
    return Rgba(s["r"], s["g"], s["b"], s["a"])


def pick(condition: Column, yes: Rgba, no: Rgba) -> Rgba:
    return Rgba(*[F.when(condition, y).otherwise(n) for y, n in zip(yes, no)])


def _to_byte(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def _unit(t) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(t)))


def clamp8(value: Column) -> Column:
    return _to_byte(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)))


def multiply(base: Rgba, tint: Rgba) -> Rgba:
    ch = [F.floor(b * t / F.lit(255)).cast("int") for b, t in zip(base[:3], tint[:3])]
    return Rgba(*ch, base.a)


def lerp(a: Rgba, b: Rgba, t) -> Rgba:
    """Blend; ``t`` is clamped once, which also makes both ends exact."""
    w = _unit(t)
    return Rgba(*[_to_byte(p + (q - p) * w) for p, q in zip(a, b)])


def scale(c: Rgba, factor) -> Rgba:
    f = col(factor)
    return c.map(lambda ch: clamp8(ch * f))


def alpha_over(top: Rgba, under: Rgba) -> Rgba:
    """Source-over compositing with the top colour's own alpha."""
    w = top.a / F.lit(255.0)
    return Rgba(
        *[_to_byte(t * w + u * (1 - w)) for t, u in zip(top[:3], under[:3])],
        F.floor(F.least(F.lit(255.0), top.a + under.a * (1 - w) + 0.5)).cast("int"),
    )


def desaturate(c: Rgba, amount: float) -> Rgba:
    luma = _to_byte(c.r * 0.299 + c.g * 0.587 + c.b * 0.114)
    return lerp(c, Rgba(luma, luma, luma, c.a), F.lit(amount))


def apply_tint(base: Rgba, tint, grass: Rgba, foliage: Rgba, water: Rgba) -> Rgba:
    """Recolour by the biome channel that the block's tint names."""
    t = col(tint)
    white = F.lit(255)
    shade = lambda g, f, w: F.when(t == "grass", g).when(t.isin("foliage", "dry"), f).when(t == "water", w).otherwise(white)
    return multiply(base, Rgba(*[shade(g, f, w) for g, f, w in zip(grass, foliage, water)]))


def water_over(floor: Rgba, water: Rgba, depth, max_depth: float = 28.0) -> Rgba:
    """Sea floor seen through water: opacity saturates, deep water darkens."""
    d = col(depth).cast("double")
    t = F.least(F.lit(0.94), 1 - F.exp(-d / F.lit(max_depth * 0.38)))
    return scale(lerp(floor, water, t), 1 - F.least(F.lit(1.0), d / F.lit(max_depth)) * 0.34)


def light_factor(light) -> Column:
    l = col(light)
    return F.when(l >= 15, F.lit(1.0)).otherwise(l * 0.45 / 15 + 0.55)


def light_style(block_light) -> Rgba:
    """Spawn-safety bands: dark, 1 to 7, 8 to 15."""
    l = col(block_light)
    caution = lerp(rgba(LIGHT_CAUTION[0]), rgba(LIGHT_CAUTION[1]), (l - 1) / 6.0)
    safe = lerp(rgba(LIGHT_SAFE[0]), rgba(LIGHT_SAFE[1]), (l - 7) / 8.0)
    return pick(l <= 0, rgba(LIGHT_DARK), pick(l <= 7, caution, safe))


def gradient(stops, t) -> Rgba:
    """Sample an evenly spaced ramp at ``t`` in [0, 1]."""
    last = len(stops) - 1
    pos = _unit(t) * float(last)
    i = F.least(F.floor(pos).cast("int"), F.lit(last - 1))
    table = F.array(*[F.array(*[F.lit(int(v)) for v in s]) for s in stops])
    at = lambda k: Rgba(*[F.element_at(F.element_at(table, k + 1), n) for n in (1, 2, 3, 4)])
    return lerp(at(i), at(i + 1), pos - i)


def height_percent(y, low, high) -> Column:
    return (col(y) - col(low)) / F.greatest(F.lit(1), col(high) - col(low)).cast("double")


def ore_style(terrain: Rgba, best, score) -> Rgba:
    """Ore colour over drained terrain, as strong as the column's score."""
    base = desaturate(terrain, 0.88)
    index = F.when(col(best) < len(ORE_COLORS), col(best)).otherwise(1)
    table = F.array(*[F.array(*[F.lit(int(v)) for v in s]) for s in ORE_COLORS])
    ore = Rgba(*[F.element_at(F.element_at(table, index + 1), n) for n in (1, 2, 3, 4)])
    strength = F.least(F.lit(1.0), col(score) / F.lit(ORE_FULL_SCORE))
    return lerp(base, ore, strength)


def parse_hex(text) -> Column:
    """``#rgb``, ``#rrggbb`` or ``#rrggbbaa`` to a colour struct; NULL if malformed."""
    s = F.trim(F.regexp_replace(F.trim(col(text)), "^#", ""))
    s = F.when(F.length(s) == 3, F.regexp_replace(s, "(.)", "$1$1")).otherwise(s)
    s = F.when(F.length(s) == 6, F.concat(s, F.lit("ff"))).otherwise(s)
    part = lambda n: F.conv(F.substring(s, n, 2), 16, 10).cast("int")
    return F.when(
        s.rlike("^[0-9A-Fa-f]{8}$"),
        F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), part(7).alias("a")),
    )


def format_hex(c: Rgba) -> Column:
    two = lambda ch: F.lpad(F.lower(F.hex(ch)), 2, "0")
    return F.concat(F.lit("#"), two(c.r), two(c.g), two(c.b))


def name_hash(text) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as a struct of two 32-bit halves.

    Spark's ANSI bigint raises on overflow, so the product with the prime
    (2^40 + 0x1b3) is carried by hand in halves that never exceed 63 bits.
    """
    digits = F.hex(F.encode(col(text), "UTF-8"))
    count = F.length(digits) / 2
    codes = F.when(
        F.length(digits) > 0,
        F.transform(
            F.sequence(F.lit(0), (count - 1).cast("int")),
            lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(state, code):
        lo = state["lo"].bitwiseXOR(code)
        product = lo * 0x1B3
        hi = state["hi"] * 0x1B3 + F.shiftright(product, 32) + lo * 256
        return F.struct(hi.bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    start = F.struct(
        F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo")
    )
    return F.aggregate(codes, start, step)


def name_color(hashed) -> Rgba:
    """Muted stable colour of an unmapped name, from its :func:`name_hash` halves."""
    hi, lo = col(hashed)["hi"], col(hashed)["lo"]
    hue = F.pmod(F.pmod(hi, F.lit(360)) * (2**32 % 360) + lo, F.lit(360)) / F.lit(360.0)
    sat = F.pmod(hi * 65536 + F.shiftright(lo, 16), F.lit(22)) / F.lit(100.0) + 0.18
    val = F.pmod(hi, F.lit(26)) / F.lit(100.0) + 0.42
    sector = F.floor(hue * 6)
    f = hue * 6 - sector
    p, q, t = val * (1 - sat), val * (1 - f * sat), val * (1 - (1 - f) * sat)
    k = F.pmod(sector, F.lit(6))
    wheel = {0: (val, t, p), 1: (q, val, p), 2: (p, val, t), 3: (p, q, val), 4: (t, p, val)}
    out = (val, p, q)
    for n in sorted(wheel, reverse=True):
        out = tuple(F.when(k == n, w).otherwise(o) for w, o in zip(wheel[n], out))
    return Rgba(*[_to_byte(c * 255) for c in out], F.lit(255))


# The ten owner colours.
OWNER_COLORS = (
    "#7ee787", "#8ea6c8", "#e07b7b", "#e6c07a", "#b48ead",
    "#5fa8ff", "#3ddc97", "#ff9f4c", "#ffd166", "#c77dff",
)


def owner_hash(owner) -> Column:
    """``h = 31 h + code`` modulo 2^32 over the characters."""
    codes = F.transform(F.filter(F.split(col(owner), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    modulus = F.lit(1 << 32)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, modulus))


def owner_color(owner) -> Column:
    table = F.array(*[F.lit(c) for c in OWNER_COLORS])
    return F.element_at(table, (F.pmod(owner_hash(owner), F.lit(len(OWNER_COLORS))) + 1).cast("int"))
