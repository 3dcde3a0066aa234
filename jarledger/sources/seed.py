"""O05 template_seed: insert catalogue templates whose id is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The two seeded physical boxes (name, stated total, the grid
# printed on the box).  The currency is the column default, UAH.  Our ids are
# integers, and those of user tables are above 0, so a seed row's is its stated total below 0.
SEED_TEMPLATES = [
    (-1000, "Скарбничка 1000 грн", 1000, "UAH",
     [5, 10, 20, 50, 5, 10, 20, 50, 100, 200, 50, 20, 10, 5, 5, 10, 20, 50, 100, 200, 50, 20]),
    (-5000, "Скарбничка 5000 грн", 5000, "UAH",
     [50, 100, 200, 500, 50, 100, 200, 500, 50, 100, 200, 500, 50, 100, 200, 500, 1000]),
]
TEMPLATE_DDL = "id BIGINT, name STRING, total_amount INT, currency STRING, grid_config ARRAY<INT>"


def seed_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_TEMPLATES, TEMPLATE_DDL)


def template_seed(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """ON CONFLICT DO NOTHING: existing rows win, absent ids are added."""
    return existing.unionByName(seed.join(existing.select("id"), "id", "left_anti"))
