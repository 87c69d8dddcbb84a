"""Literal relations of the catalog: fabrics and the first colours with their swatches, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fabrics, and canonical colours that a catalog starts with.
FABRICS = ["Lawn", "Khaddar", "Cambric", "Cotton", "Silk", "Chiffon", "Denim", "Polyester", "Linen", "Wool", "Blended", "Organza", "Velvet"]
COLORS = [
    ("Black", "#1c1c1c"), ("White", "#f5f5f0"), ("Off-White", "#efe8da"), ("Grey", "#8a8a8a"), ("Navy", "#1b2a4a"), ("Blue", "#2f5fa8"), ("Red", "#b02a2a"), ("Maroon", "#5c1f1f"),
    ("Green", "#2f6b3a"), ("Olive", "#6b6b2f"), ("Beige", "#d9c7a3"), ("Brown", "#5a3a28"), ("Coffee", "#5a3a28"), ("Pink", "#e08bb0"), ("Yellow", "#d9b93a"), ("Mustard", "#c9962a"),
    ("Orange", "#d9752a"), ("Purple", "#6b3aa0"), ("Multi", "#999999"), ("Mushroom", "#c7b299"),
]
# End of the fixed values.


def values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """The rows as a literal relation that Spark plans as such (no Python at run time), with ids from 1."""
    text = lambda x: "'" + str(x).replace("'", "''") + "'"
    lines = ", ".join(f"({i}L, {', '.join(map(text, row))})" for i, row in enumerate(rows, 1))
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t(id, {', '.join(names)})")


def fabrics(spark: SparkSession) -> DataFrame:
    """id, name."""
    return values(spark, [(x,) for x in FABRICS], ["name"])


def colors(spark: SparkSession) -> DataFrame:
    """id, name, hex."""
    return values(spark, COLORS, ["name", "hex"])
