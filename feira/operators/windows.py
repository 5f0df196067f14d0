"""Report windows as a table, so that one plan serves several of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from feira.config import Config, Quarter
from feira.operators.tables import PERIOD_FOLDERS, refresh_table

REPORT = "relatorio"


def report_windows(cfg: Config) -> dict[str, tuple[Quarter, ...]]:
    """The windows of the reports over purchases, by name."""
    w = cfg.windows
    return {
        "compras": w.purchases,
        "compradores_funil": w.funnel_buyers,
        "ultimo_trimestre": w.funnel_last_quarter,
    }


def store_windows(spark: SparkSession, windows: Mapping[str, Sequence[Quarter]], path: str) -> DataFrame:
    """A stored table ``relatorio, ano, trimestre``: a row for each quarter of each report."""
    rows = [(name, year, q) for name, quarters in windows.items() for year, q in sorted(set(quarters))]
    return refresh_table(spark.createDataFrame(rows, f"{REPORT} string, ano int, trimestre int"), path)


def in_windows(df: DataFrame, windows: DataFrame, reports: Sequence[str]) -> DataFrame:
    """Rows of ``df`` for each report whose window holds their quarter; a row is there once per such report.

    On a table with quarter folders the windows prune the scan while the plan runs: only quarters that one of
    the reports asks for are read.
    """
    wanted = windows.where(windows[REPORT].isin(list(reports)))
    return df.join(wanted, list(PERIOD_FOLDERS))
