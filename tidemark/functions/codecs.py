"""Codecs between payload bytes and columns; what can't be decoded is null, and dropped by ``decode``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tidemark.errors import ConfigError, ConnectorUnavailable
from tidemark.functions.binary import BinaryCodec


@dataclass(frozen=True)
class StringCodec:
    """UTF-8 text."""

    def decode(self, payload: Column) -> Column:
        return payload.cast("string")

    def encode(self, value: Column) -> Column:
        return value.cast("string").cast("binary")


@dataclass(frozen=True)
class JsonCodec:
    """JSON text of a declared schema (DDL)."""

    schema: str

    def decode(self, payload: Column) -> Column:
        fields = [f.name for f in _parse_datatype_string(self.schema).fields]
        parsed = F.from_json(payload.cast("string"), f"{self.schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
        return F.when(parsed["_broken"].isNull(), F.struct(*[parsed[f].alias(f) for f in fields]))

    def encode(self, value: Column) -> Column:
        return F.to_json(value).cast("binary")


@dataclass(frozen=True)
class AvroCodec:
    """Avro of a JSON schema; needs the spark-avro package on the class path."""

    schema: str

    def decode(self, payload: Column) -> Column:
        from pyspark.sql.avro.functions import from_avro

        return from_avro(payload, self.schema)

    def encode(self, value: Column) -> Column:
        from pyspark.sql.avro.functions import to_avro

        return to_avro(value, self.schema)


def codec(name: str, schema: str = "") -> StringCodec | JsonCodec | AvroCodec | BinaryCodec:
    made = {"string": lambda: StringCodec(), "json": lambda: JsonCodec(schema), "avro": lambda: AvroCodec(schema), "bincode": lambda: BinaryCodec(schema)}
    if name not in made:
        raise ConfigError(f"unknown codec {name!r}")
    return made[name]()


def decode(df: DataFrame, with_codec, payload: str = "value", into: str = "value") -> DataFrame:
    """Replace the payload by its value; rows that can't be decoded are dropped."""
    try:
        return df.withColumn(into, with_codec.decode(F.col(payload))).where(F.col(into).isNotNull())
    except AnalysisException as e:
        if "AVRO_NOT_LOADED" in str(e):
            raise ConnectorUnavailable("Avro needs the spark-avro package on the class path") from e
        raise
