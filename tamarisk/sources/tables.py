"""Text tables with tag rows, and code lists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.operators.relational import drop_tag_rows, snake_names

# Boundary layers by country and level.
LAYERS = {
    "Somalia": ("som_admbnda_adm0_ocha_20230308", "som_admbnda_adm1_ocha_20230308", "som_admbnda_adm2_ocha_20230308"),
    "Ethiopia": ("eth_admbnda_adm0_csa_bofedb_itos_2021", "eth_admbnda_adm1_csa_bofedb_2021", "eth_admbnda_adm2_csa_bofedb_2021"),
    "Kenya": ("ken_admbnda_adm0_iebc_20191031", "ken_admbnda_adm1_iebc_20191031", "ken_admbnda_adm2_iebc_20191031"),
}

# Countries of the food-security analyses.
COUNTRIES = (
    ("AO", "AGO", "Angola"), ("BW", "BWA", "Botswana"), ("SZ", "SWZ", "Eswatini"), ("LS", "LSO", "Lesotho"), ("MG", "MDG", "Madagascar"), ("MW", "MWI", "Malawi"),
    ("MZ", "MOZ", "Mozambique"), ("NA", "NAM", "Namibia"), ("ZA", "ZAF", "South Africa"), ("ZM", "ZMB", "Zambia"), ("ZW", "ZWE", "Zimbabwe"),
    ("ET", "ETH", "Ethiopia"), ("KE", "KEN", "Kenya"), ("SO", "SOM", "Somalia"),
)


def data_path(*parts: str, root: str | None = None) -> str:
    """A path below the data folder: `root`, or the folder that TAMARISK_DATA_DIR names."""
    base = root or os.environ.get("TAMARISK_DATA_DIR")
    if not base:
        raise ValueError("name a data folder, or set TAMARISK_DATA_DIR")
    return "/".join([base.rstrip("/"), *parts])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, null: str | None = "NA", tags: str | None = None) -> DataFrame:
    """A CSV file as text columns, empty fields and `null` as null; names in snake case.

    `tags`: the column by whose # the row of tags below the header is told and dropped. Give `null=None` where NA is
    a value, as in country codes. `columns`, the header's names in order, saves reading the header.
    """
    reader = spark.read.option("header", True).option("enforceSchema", columns is None)
    if null is not None:
        reader = reader.option("nullValue", null)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    found = snake_names(reader.csv(path))
    found = found.select([F.when(F.col(c) != "", F.col(c)).alias(c) for c in found.columns])
    return drop_tag_rows(found, tags) if tags else found


def country_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "iso2 string, iso3 string, country_name string")


def layer_names(spark: SparkSession, layers: dict[str, tuple[str, ...]] = LAYERS) -> DataFrame:
    rows = [(country, f"adm{i}", name) for country, names in layers.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "country string, level string, layer string")


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """Food-insecurity phase rows kept as JSON lines or Parquet."""
    return snake_names(spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path))
