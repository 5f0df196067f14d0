"""feira: marketplace analytics as parameterised Spark DataFrame operators."""

from feira.config import Config, Windows

__all__ = ["Config", "Windows"]
