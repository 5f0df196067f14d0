"""Small hand-made source tables."""

from datetime import datetime
from decimal import Decimal
from pathlib import Path

from feira.sources.marketplace import SCHEMAS

TESTDATA = Path("/root/testdata")

T0 = datetime(2022, 5, 1, 10, 30)


def pedidos(spark, *rows):
    """Rows of (id, cliente_id, nome, valor, comercio_id, status, time)."""
    full = [
        (i, c, n, f"{n}@Mail.com", Decimal(v), Decimal("1.50"), s, st, t)
        for i, c, n, v, s, st, t in rows
    ]
    return spark.createDataFrame(full, SCHEMAS["pedidos"])


def comercios(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["comercios"])


def cliente(id, nome="Ana", sobrenome="Lima", email="ana@mail.com", celular="11-9-8", cpf="1",
            cnpj=None, tipo_pessoa="F", status="Ativo", time=T0):
    return (id, nome, sobrenome, email, celular, cpf, cnpj, tipo_pessoa, status, time)


def clientes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["clientes"])


def enderecos(spark, *rows):
    """Rows of (id, cliente_id, cep)."""
    full = [(i, c, cep, "Centro", "Santos", "SP") for i, c, cep in rows]
    return spark.createDataFrame(full, SCHEMAS["enderecos"])


def segments(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["segments"])


def app(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["analytics_app"])


def rows(df):
    return [tuple(r) for r in df.collect()]
