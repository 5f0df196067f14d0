"""Curated tables in the text form the reports were once read from.

Dates are ``dd/mm/yyyy``, quarters ``q/yyyy``, everything else plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feira.functions.dates import iso_date, month_start, parse_day_month_year, quarter_token
from feira.plans.curated import PERIOD_COLUMNS

DATE_TEXT_COLUMNS = ("data_compra", "data_cadastro")

# types of the columns that are not text
COLUMN_TYPES = {
    "compra_id": "bigint",
    "cliente_id": "bigint",
    "comercio_id": "bigint",
    "valor": "decimal(12,2)",
    "frete": "decimal(12,2)",
    "status_pedido": "int",
    "status_cliente": "int",
    "row_num": "int",
}


def to_report_snapshot(curated: DataFrame) -> DataFrame:
    """Render a curated table as text columns."""

    def render(name: str) -> Column:
        if name in DATE_TEXT_COLUMNS:
            return F.date_format("dia", "dd/MM/yyyy")
        if name == "quarter":
            return quarter_token(F.col("ano"), F.col("trimestre"), "/")
        return F.col(name).cast("string")

    kept = [c for c in curated.columns if c not in PERIOD_COLUMNS]
    return curated.select(*(render(c).alias(c) for c in kept))


def from_report_snapshot(snapshot: DataFrame) -> DataFrame:
    """Parse the text form back into a typed curated table.

    Text that does not parse becomes NULL. The quarter columns come from the
    quarter text, day and month from the date text; there is no ``time``, so
    the quarter text alone decides which period a row is in.
    """
    date_text = next(c for c in DATE_TEXT_COLUMNS if c in snapshot.columns)
    return snapshot.select(*_parsed_columns(snapshot, date_text))


def _parsed_columns(snapshot: DataFrame, date_text: str) -> list[Column]:
    parts = F.split("quarter", "/")
    ano = F.try_element_at(parts, F.lit(2)).try_cast("int")
    trimestre = F.try_element_at(parts, F.lit(1)).try_cast("int")
    dia = parse_day_month_year(F.col(date_text))

    def parse(name: str) -> Column:
        if name == date_text:
            return iso_date(dia)
        if name == "quarter":
            return quarter_token(ano, trimestre)
        return F.col(name).try_cast(COLUMN_TYPES.get(name, "string"))

    return [
        *(parse(c).alias(c) for c in snapshot.columns),
        dia.alias("dia"),
        month_start(dia).alias("mes"),
        ano.alias("ano"),
        trimestre.alias("trimestre"),
    ]


REASON, TAKEN = "motivo", "aceita"


def split_snapshot(snapshot: DataFrame, path: str, seen: Observation) -> tuple[DataFrame, DataFrame]:
    """Parse a snapshot and part it: the typed rows, and the rows as they came with ``motivo``, why they are rejected.

    A row is rejected for every column whose text is there and does not parse, and for a quarter that does not
    exist or does not hold the row's date; ``motivo`` names these columns, comma-joined. One pass writes both under ``path``, in folders apart, and counts them:
    ``seen`` then holds ``linhas``, ``aceitas`` and ``rejeitadas``.
    """
    date_text = next(c for c in DATE_TEXT_COLUMNS if c in snapshot.columns)
    typed = from_report_snapshot(snapshot)
    row = snapshot.select(
        F.struct(*snapshot.columns).alias("texto"), F.struct(*_parsed_columns(snapshot, date_text)).alias("lida")
    )
    lost = [
        F.when(F.col(f"texto.{c}").isNotNull() & F.col(f"lida.{c}").isNull(), F.lit(c))
        for c in snapshot.columns
        if c in COLUMN_TYPES or c == date_text
    ]
    day, year, q = F.col("lida.dia"), F.col("lida.ano"), F.col("lida.trimestre")
    wrong = q.isNull() | year.isNull() | ~q.between(1, 4) | (day.isNotNull() & ((F.year(day) != year) | (F.quarter(day) != q)))
    lost.append(F.when(F.col("texto.quarter").isNotNull() & wrong, F.lit("quarter")))
    reason = F.concat_ws(",", *lost)
    judged = row.withColumn(REASON, F.nullif(reason, F.lit(""))).withColumn(TAKEN, F.col(REASON).isNull())
    counted = judged.observe(
        seen,
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(TAKEN).alias("aceitas"),
        F.count_if(~F.col(TAKEN)).alias("rejeitadas"),
    )
    counted.write.mode("overwrite").partitionBy(TAKEN).parquet(path)
    stored = snapshot.sparkSession.read.schema(judged.schema).parquet(path)
    kept = stored.where(TAKEN).select(*(F.col(f"lida.{c}").alias(c) for c in typed.columns))
    rejected = stored.where(~F.col(TAKEN)).select(*(F.col(f"texto.{c}").alias(c) for c in snapshot.columns), REASON)
    return kept, rejected
