"""The marketplace source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ``db_app`` is passed through with whatever columns it has.
SCHEMAS: dict[str, str | None] = {
    "db_app": None,
    "pedidos": (
        "id bigint, cliente_id bigint, nome string, email string, valor decimal(12,2), "
        "frete decimal(12,2), comercio_id bigint, status string, time timestamp_ntz"
    ),
    "comercios": "id bigint, nome_fantasia string",
    "clientes": (
        "id bigint, nome string, sobrenome string, email string, celular string, cpf string, "
        "cnpj string, tipo_pessoa string, status string, time timestamp_ntz"
    ),
    "enderecos": (
        "id bigint, cliente_id bigint, cep string, bairro string, cidade string, estado string"
    ),
    "analytics_app": "data date, total_visitas bigint, total_downloads bigint",
    "segments": "email string, segment string",
}


class Marketplace:
    """The source tables as attributes, each opened when first used."""

    def __init__(self, open_table: Callable[[str], DataFrame]) -> None:
        self._open_table = open_table

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self._open_table(name)
        setattr(self, name, table)
        return table


def from_files(
    spark: SparkSession, root: str, fmt: str = "parquet", **options: str
) -> Marketplace:
    """Tables stored as ``root/<table>`` in any file format Spark reads."""

    def load(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        schema = SCHEMAS[name]
        return (reader.schema(schema) if schema else reader).load(f"{root}/{name}")

    return Marketplace(load)


def from_catalog(spark: SparkSession, database: str | None = None) -> Marketplace:
    """Tables (or views) of a catalog database; the current one when not named.

    Columns are cast to the types the plans rely on: money stored as a double
    would be summed inexactly.
    """
    prefix = f"{database}." if database else ""

    def load(name: str) -> DataFrame:
        table, schema = spark.table(prefix + name), SCHEMAS[name]
        if not schema:
            return table
        fields = StructType.fromDDL(schema).fields
        return table.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))

    return Marketplace(load)
