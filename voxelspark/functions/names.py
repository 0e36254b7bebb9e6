"""Rules that read meaning out of block, biome and dimension names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import Rgba
from .grid import col

# Fixed value: the namespace of an identifier written without one.
DEFAULT_NAMESPACE = "minecraft"
AIR = f"{DEFAULT_NAMESPACE}:air"
PLAINS = f"{DEFAULT_NAMESPACE}:plains"

# Ore kinds from least to most valuable, with their points per
# block, and the name fragment of each. Order of the fragments matters.
ORE_KINDS = ("none", "other", "coal", "copper", "iron", "lapis", "redstone", "gold", "emerald", "diamond", "debris")
ORE_POINTS = (0, 1, 0, 0, 0, 1, 1, 4, 10, 12, 20)
ORE_FRAGMENTS = (
    ("ancient_debris", 10),
    ("diamond_ore", 9),
    ("emerald_ore", 8),
    ("gold_ore", 7),
    ("redstone_ore", 6),
    ("lapis_ore", 5),
    ("iron_ore", 4),
    ("copper_ore", 3),
    ("coal_ore", 2),
)

# Name endings and whole names that imply a block height.
HEIGHT_ENDINGS = (
    ("_slab", 0.5),
    ("_stairs", 0.5),
    ("_carpet", 0.0625),
    ("_trapdoor", 0.1875),
    ("_bed", 0.5625),
)
HEIGHT_NAMES = {
    "slab": 0.5,
    "stairs": 0.5,
    "carpet": 0.0625,
    "farmland": 0.9375,
    "dirt_path": 0.9375,
    "grass_path": 0.9375,
    "enchanting_table": 0.75,
    "soul_sand": 0.875,
    "mud": 0.875,
}

# Tints of unmapped biomes, by the first family whose keyword
# occurs in the name. (keywords, grass, foliage, water); None keeps the default.
BIOME_DEFAULT = ("#8eb971", "#71a74d", "#3f76e4")
BIOME_FAMILIES = (
    ("desert|badlands|mesa|dune|sand", "#bfb755", "#aea42a", None),
    ("snow|frozen|ice|glacier|tundra", "#80b497", "#60a17b", "#3938c9"),
    ("jungle|rainforest|tropic", "#59c93c", "#30bb0b", None),
    ("swamp|marsh|bog|mangrove", "#6a7039", "#6a7039", "#617b64"),
    ("savanna|steppe|shrub", "#bfb755", "#aea42a", None),
    ("taiga|spruce|pine|boreal", "#86b783", "#68a464", None),
    ("nether|crimson|warped|soul|basalt", "#9a5040", "#8a4035", "#90592c"),
    ("end|void|chorus", "#c0bd8f", "#b0ac7f", "#403a5e"),
    ("ocean|river|beach|shore", "#8eb971", None, "#3d6fd4"),
)

# Chunk generation states with a usable surface.
USABLE_STATUS = ("", "full", "postprocessed", "fullchunk", "heightmaps", "spawn", "light")

# Pre-palette numeric biome ids.
LEGACY_BIOMES = {
    0: "ocean", 1: "plains", 2: "desert", 3: "windswept_hills", 4: "forest", 5: "taiga",
    6: "swamp", 7: "river", 8: "nether_wastes", 9: "the_end", 10: "frozen_ocean",
    11: "frozen_river", 12: "snowy_plains", 13: "snowy_plains", 14: "mushroom_fields",
    15: "mushroom_fields", 16: "beach", 17: "desert", 18: "forest", 19: "taiga",
    20: "windswept_hills", 21: "jungle", 22: "jungle", 23: "sparse_jungle", 24: "deep_ocean",
    25: "stony_shore", 26: "snowy_beach", 27: "birch_forest", 28: "birch_forest",
    29: "dark_forest", 30: "snowy_taiga", 31: "snowy_taiga", 32: "old_growth_pine_taiga",
    33: "old_growth_pine_taiga", 34: "windswept_forest", 35: "savanna", 36: "savanna_plateau",
    37: "badlands", 38: "wooded_badlands", 39: "badlands", 40: "small_end_islands",
    41: "end_midlands", 42: "end_highlands", 43: "end_barrens", 44: "warm_ocean",
    45: "lukewarm_ocean", 46: "cold_ocean", 47: "deep_lukewarm_ocean", 48: "deep_cold_ocean",
    49: "deep_frozen_ocean", 50: "deep_frozen_ocean", 127: "the_void", 129: "sunflower_plains",
    130: "desert", 131: "windswept_gravelly_hills", 132: "flower_forest", 133: "taiga",
    134: "swamp", 140: "ice_spikes", 149: "jungle", 151: "sparse_jungle",
    155: "old_growth_birch_forest", 156: "old_growth_birch_forest", 157: "dark_forest",
    158: "snowy_taiga", 160: "old_growth_spruce_taiga", 161: "old_growth_spruce_taiga",
    162: "windswept_hills", 163: "windswept_savanna", 164: "savanna_plateau",
    165: "eroded_badlands", 166: "wooded_badlands", 167: "badlands", 168: "bamboo_jungle",
    169: "bamboo_jungle", 174: "dripstone_caves", 175: "lush_caves", 177: "meadow", 178: "grove",
    179: "snowy_slopes", 180: "jagged_peaks", 181: "frozen_peaks", 182: "stony_peaks",
}


def normalize(name) -> Column:
    """Trim, lower-case, drop a ``[state]`` suffix and add the default namespace."""
    s = F.regexp_replace(F.lower(F.trim(col(name))), r"(?s)\[.*$", "")
    return (
        F.when(s == "", F.lit(AIR))
        .when(s.contains(":"), s)
        .otherwise(F.concat(F.lit(f"{DEFAULT_NAMESPACE}:"), s))
    )


def local_name(name) -> Column:
    return F.regexp_replace(F.lower(col(name)), "^[^:]*:", "")


def safe_id(name) -> Column:
    """File- and URL-safe token of at most 128 characters."""
    s = F.regexp_replace(F.lower(F.trim(col(name))), "[^a-z0-9_.-]", "_")
    s = F.regexp_replace(s, "^[.-]+", "")
    return F.when(s == "", F.lit("unknown")).otherwise(F.substring(s, 1, 128))


def pretty_name(name) -> Column:
    """``ns:deep_dark`` becomes ``Deep Dark``; letters after the first are kept."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(col(name), "^[^:]*:", ""), "[_\\s]+", " ")), " ")
    title = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " "
    )
    return F.when(title == "", col(name)).otherwise(title)


def classify_ore(name) -> Column:
    """Rank of the ore a block name stands for; 0 is none."""
    n = local_name(name)
    out = F.when(n.contains(ORE_FRAGMENTS[0][0]), ORE_FRAGMENTS[0][1])
    for fragment, kind in ORE_FRAGMENTS[1:]:
        out = out.when(n.contains(fragment), kind)
    return out.when(n.endswith("_ore") | n.contains("_ore_"), 1).otherwise(0)


def ore_points(kind) -> Column:
    table = F.array(*[F.lit(p) for p in ORE_POINTS])
    k = col(kind)
    return F.when(k < len(ORE_POINTS), F.element_at(table, k + 1)).otherwise(ORE_POINTS[1])


def infer_height(name) -> Column:
    """Block height implied by a name, NULL when the name says nothing."""
    n = local_name(name)
    out = None
    for ending, height in HEIGHT_ENDINGS:
        hit = n.endswith(ending)
        out = F.when(hit, F.lit(height)) if out is None else out.when(hit, F.lit(height))
    for whole, height in HEIGHT_NAMES.items():
        out = out.when(n == whole, F.lit(height))
    return out


def biome_tints(name) -> tuple[Rgba, Rgba, Rgba]:
    """Grass, foliage and water colours guessed from a biome name."""
    key = col(name)
    chosen = []
    for slot in (1, 2, 3):
        default = BIOME_DEFAULT[slot - 1]
        text = None
        for family in BIOME_FAMILIES:
            value = F.lit(family[slot] or default)
            hit = key.rlike(family[0])
            text = F.when(hit, value) if text is None else text.when(hit, value)
        chosen.append(text.otherwise(F.lit(default)))
    channel = lambda t, n: F.conv(F.substring(t, n, 2), 16, 10).cast("int")
    return tuple(Rgba(channel(t, 2), channel(t, 4), channel(t, 6), F.lit(255)) for t in chosen)


def legacy_biome(number) -> Column:
    pairs = [x for k, v in LEGACY_BIOMES.items() for x in (F.lit(k), F.lit(f"{DEFAULT_NAMESPACE}:{v}"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(number).cast("int")), F.lit(PLAINS))


def is_usable_status(status) -> Column:
    return F.regexp_replace(F.coalesce(col(status), F.lit("")), f"^{DEFAULT_NAMESPACE}:", "").isin(*USABLE_STATUS)


# Accepted spellings of the enumerations.
STYLES = ("terrain", "biome", "height", "light", "ore", "contour")
MODES = {"": "top", "top": "top", "iso": "iso"}
CAMERA_NAMES = {
    "": "se", "se": "se", "SE": "se", "south_east": "se",
    "sw": "sw", "SW": "sw", "south_west": "sw",
    "nw": "nw", "NW": "nw", "north_west": "nw",
    "ne": "ne", "NE": "ne", "north_east": "ne",
}
TINTS = {"grass": "grass", "foliage": "foliage", "leaves": "foliage", "water": "water", "dry": "dry", "dry_foliage": "dry"}


def _lookup(value: Column, table: dict, default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit(""))), F.lit(default))


def parse_style(text) -> Column:
    return _lookup(col(text), {s: s for s in STYLES}, "terrain")


def parse_mode(text) -> Column:
    return _lookup(F.lower(col(text)), MODES, "top")


def parse_camera(text) -> Column:
    return _lookup(col(text), CAMERA_NAMES, "se")


def parse_tint(text) -> Column:
    return _lookup(F.lower(col(text)), TINTS, "none")
