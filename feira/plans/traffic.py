"""App traffic reports over ``analytics_app``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions.dates import month_start
from feira.operators.aggregates import monthly


def app_totals(app: DataFrame) -> DataFrame:
    return app.agg(
        F.sum("total_visitas").alias("visitas_2022"),
        F.sum("total_downloads").alias("downloads_2022"),
    )


def app_monthly(app: DataFrame) -> DataFrame:
    """Visits and downloads per month; undated rows make a NULL month."""
    return monthly(
        app,
        month_start(F.col("data")),
        F.sum("total_visitas").alias("visitas_mes"),
        F.sum("total_downloads").alias("downloads_mes"),
    )
