"""Colour ramps as tables, and pixel colours by a look-up join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The gradients' stops, low to high.
GRADIENTS = {
    "FloodAlertRed": ["#000000", "#1A1A1A", "#333333", "#FFFF00", "#FFD700", "#FFA500", "#FF8C00", "#FF4500", "#FF0000", "#CC0000", "#800000", "#4D0000"],
    "NeonFloodCyan": ["#000020", "#000050", "#4B0082", "#800080", "#9932CC", "#00FFFF", "#00CED1", "#40E0D0", "#32CD32", "#008000", "#004D00", "#000000"],
    "TropicWarning": ["#1A0030", "#2E004F", "#4B0082", "#76FF03", "#64DD17", "#00C853", "#FF00FF", "#D500F9", "#AA00FF", "#FF6D00", "#E65100", "#BF360C"],
    "VolcanicEruption": ["#FFFF00", "#FFD700", "#FFA500", "#FF8C00", "#FF4500", "#FF0000", "#B22222", "#8B0000", "#4B0082", "#2E1A47", "#1A0030", "#0B0611"],
    "AquaCopper": ["#3B1E0F", "#593018", "#8E4D23", "#C46A2F", "#D7A170", "#EAD9B0", "#D4E0CA", "#BFE7E3", "#6FC0C6", "#1F9AA9", "#0F6B77", "#003C46"],
    "PeacockBronze": ["#0B4F6C", "#11667A", "#177E89", "#5EAB97", "#A6D9C8", "#CBE1CD", "#F0EAD2", "#D0BA9D", "#B08968", "#86634B", "#5C3D2E", "#3D281E"],
    "GlacierLava": ["#0F172A", "#162B6C", "#1E40AF", "#5882D6", "#93C5FD", "#BCD6F4", "#E5E7EB", "#EC9595", "#EF4444", "#9D3030", "#4B1D1D", "#250E0E"],
    "SunsetDune": ["#2E1A47", "#5E2A64", "#8E3B82", "#C06399", "#F28CB1", "#F8AFA7", "#FFD29D", "#F2A85F", "#E67E22", "#B05E11", "#7B3F00", "#4A2600"],
    "EsriClassic": ["#00204D", "#351062", "#6A0177", "#355BBA", "#00B5FF", "#67D2FF", "#CFEFFF", "#E7EBCA", "#FFE98A", "#E3C983", "#C8A97D", "#4B2E2B"],
    "CyanDeepBlue": ["#C4F7FF", "#A7EFFF", "#8AE7FF", "#64DDFF", "#3FD4FF", "#1FB1ED", "#008FDB", "#0068AD", "#00427F", "#002955", "#00112B", "#000510"],
    "MagmaRamp": ["#FFB347", "#FF9623", "#FF7A00", "#FF5F00", "#FF4500", "#995559", "#3366B3", "#1E4A8E", "#0A2F6A", "#061B3E", "#020712", "#000000"],
}
# The solid colours; their alpha falls from low to high values.
SOLIDS = {
    "SolidBlue": "#0050A1",
    "SolidPurple": "#5B2C83",
    "SolidGold": "#C49A00",
    "SolidGray": "#555555",
    "SolidRed": "#B22222",
    "SolidBlack": "#000000",
    "SolidOrange": "#FF8C00",
    "SolidNavy": "#000080",
    "SolidGreen": "#008000",
}
# Other names of ramps.
ALIASES = {"EsriRemClassic": "EsriClassic", "Esri REM Classic": "EsriClassic"}

SIZE = 256


def palette_rows() -> list[tuple[str, int, float, float, float, float]]:
    """(ramp, stop, r, g, b, a) with channels in [0, 1]."""
    channels = lambda h: [int(h[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    rows = [(name, i, *channels(h), 1.0) for name, stops in GRADIENTS.items() for i, h in enumerate(stops)]
    return rows + [(name, i, *channels(h), 1.0 - i) for name, h in SOLIDS.items() for i in (0, 1)]


def palette(spark: SparkSession) -> DataFrame:
    """The stops of every ramp, and of the other names."""
    rows = palette_rows()
    return spark.createDataFrame(rows + [(alias, *r[1:]) for alias, name in ALIASES.items() for r in rows if r[0] == name], "ramp string, stop int, r double, g double, b double, a double")


def lookup(stops: DataFrame, gamma: float = 0.5, size: int = SIZE) -> DataFrame:
    """(ramp, idx, r, g, b, a): `size` entries per ramp; entry j is the evenly stopped ramp at (j / (size - 1)) ** gamma.

    The base ramp itself has `size` entries, and a value v takes its entry least(floor(v * size), size - 1).
    """
    last = stops.groupBy("ramp").agg(F.max("stop").alias("last"))
    entries = last.select("ramp", "last", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("idx"))
    base = F.least(F.floor(F.pow(F.col("idx") / (size - 1), F.lit(gamma)) * size), F.lit(size - 1)) / (size - 1)
    entries = entries.withColumn("at", base * F.col("last")).withColumn("lo", F.least(F.floor("at"), F.col("last") - 1).cast("int")).withColumn("t", F.col("at") - F.col("lo"))
    x, y = (stops.select("ramp", (F.col("stop") - d).alias("lo"), *(F.col(c).alias(f"{c}{d}") for c in "rgba")) for d in (0, 1))
    return entries.join(x, ["ramp", "lo"]).join(y, ["ramp", "lo"]).select("ramp", "idx", *((F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("t")).alias(c) for c in "rgba"))


def rem_colour(pixels: DataFrame, table: DataFrame, ramp: str, low: float | Column, high: float | Column) -> DataFrame:
    """pixels (z, ...) with r, g, b, a by the look-up table of one ramp (256 rows, broadcast); a masked pixel has alpha 0. low, high: numbers, or columns of the pixels."""
    v = F.least(F.greatest((F.col("z") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    keyed = pixels.withColumn("idx", F.least(F.floor(v * SIZE), F.lit(SIZE - 1)).cast("int"))
    colours = F.broadcast(table.where(F.col("ramp") == ramp).drop("ramp"))
    return keyed.join(colours, "idx", "left").drop("idx").withColumn("a", F.when(F.col("z").isNull(), 0.0).otherwise(F.col("a"))).fillna(1.0, ["r", "g", "b"])
