"""Fixed dimension tables: materials, mixtures, visuals, colours, modes, and their look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Material constants; metal draws all three from mixtures of (mean, deviation, weight).
MATERIALS = {
    "metal": (None, None, None),
    "wood": (0.4, 600.0, "0.5"),
    "rubber": (0.95, 1100.0, "1.0"),
    "glass": (0.6, 2500.0, "0.2"),
    "plastic": (0.7, 1200.0, "0.4"),
}
METAL_MIXTURES = {
    "elasticity": ((0.85, 0.02, 0.4), (0.92, 0.01, 0.6)),
    "density": (
        (7850.0, 50.0, 0.30),
        (7950.0, 40.0, 0.20),
        (2700.0, 30.0, 0.15),
        (8940.0, 60.0, 0.10),
        (7140.0, 70.0, 0.08),
        (8500.0, 100.0, 0.07),
        (8900.0, 80.0, 0.05),
        (7300.0, 200.0, 0.03),
        (19320.0, 100.0, 0.02),
    ),
    "friction": ((0.28, 0.02, 0.5), (0.32, 0.02, 0.5)),
}
# Opacity, specular reflection and shininess by material.
VISUALS = {"glass": (0.5, 0.6, 50), "metal": (1.0, 1.0, 100), "wood": (1.0, 0.2, 10), "rubber": (1.0, 0.0, 0), "plastic": (1.0, 0.3, 5)}
# Colours as red, green, blue, opacity.
COLORS = {
    "gray": "0.5 0.5 0.5 1.0",
    "blue": "0.0 0.2 0.7 1.0",
    "brown": "0.5 0.3 0.1 1.0",
    "cyan": "0.0 0.6 0.6 1.0",
    "green": "0.0 0.6 0.0 1.0",
    "purple": "0.5 0.1 0.5 1.0",
    "red": "0.7 0.1 0.1 1.0",
    "yellow": "0.7 0.7 0.1 1.0",
    "vibrant_pink": "1.0 0.2 0.8 1.0",
    "teal": "0.3 0.8 1.0 1.0",
    "strong_yellow": "1.0 0.8 0.1 1.0",
    "bright_red": "1.0 0.3 0.3 1.0",
    "bright_green": "0.6 1.0 0.2 1.0",
}
# Motion modes and their weights.
MODES = (("collision", 0.4), ("sliding", 0.2), ("stationary", 0.2), ("offset", 0.2))


def materials(spark: SparkSession) -> DataFrame:
    rows = [(m, *MATERIALS[m], *VISUALS[m]) for m in MATERIALS]
    return spark.createDataFrame(
        rows, "material string, elasticity double, density double, friction string, alpha double, specular double, shininess int"
    ).coalesce(1)


def colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(COLORS.items())], "color_idx int, color string, rgba string").coalesce(1)
