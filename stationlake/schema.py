"""Canonical columns of a station reading and the settings of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Header text after standardisation and accent folding -> our name.
HEADER_ALIASES = {
    "DATA": "obs_date",
    "DATA YYYY-MM-DD": "obs_date",
    "HORA UTC": "obs_hour",
    "PRECIPITACAO TOTAL HORARIO MM": "precip_mm",
    "PRESSAO ATMOSFERICA AO NIVEL DA ESTACAO HORARIA MB": "pressure_mb",
    "PRESSAO ATMOSFERICA MAX.NA HORA ANT. AUT MB": "pressure_max_mb",
    "PRESSAO ATMOSFERICA MAX. NA HORA ANT. AUT MB": "pressure_max_mb",
    "PRESSAO ATMOSFERICA MIN. NA HORA ANT. AUT MB": "pressure_min_mb",
    "RADIACAO GLOBAL KJ/M²": "radiation_kjm2",
    "TEMPERATURA DO AR - BULBO SECO HORARIA °C": "temp_c",
    "TEMPERATURA DO PONTO DE ORVALHO °C": "dewpoint_c",
    "TEMPERATURA MAXIMA NA HORA ANT. AUT °C": "temp_max_c",
    "TEMPERATURA MINIMA NA HORA ANT. AUT °C": "temp_min_c",
    "TEMPERATURA ORVALHO MAX. NA HORA ANT. AUT °C": "dewpoint_max_c",
    "TEMPERATURA ORVALHO MIN. NA HORA ANT. AUT °C": "dewpoint_min_c",
    "UMIDADE REL. MAX. NA HORA ANT. AUT %": "humidity_max",
    "UMIDADE REL. MIN. NA HORA ANT. AUT %": "humidity_min",
    "UMIDADE RELATIVA DO AR HORARIA %": "humidity",
    "UMIDADE RELATIVA DO AR - HORARIA %": "humidity",
    "VENTO DIRECAO HORARIA GR ° GR": "wind_dir_deg",
    "VENTO RAJADA MAXIMA M/S": "wind_gust_ms",
    "VENTO VELOCIDADE HORARIA M/S": "wind_ms",
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "ALTITUDE": "altitude",
    "REGIAO": "region",
    "UF": "state",
    "ESTACAO": "station",
    "CODIGO WMO": "wmo_code",
    "DATA DE FUNDACAO": "founded_year",
    "YEAR": "year",
}

MEASURES = [
    "precip_mm",
    "pressure_mb",
    "pressure_max_mb",
    "pressure_min_mb",
    "radiation_kjm2",
    "temp_c",
    "dewpoint_c",
    "temp_max_c",
    "temp_min_c",
    "dewpoint_max_c",
    "dewpoint_min_c",
    "humidity_max",
    "humidity_min",
    "humidity",
    "wind_dir_deg",
    "wind_gust_ms",
    "wind_ms",
]

TARGET = "temp_c"

STATION_KEYS = ["state", "station", "wmo_code", "latitude", "longitude", "altitude"]

REQUIRED = [
    "obs_date",
    "obs_hour",
    "precip_mm",
    "pressure_mb",
    "radiation_kjm2",
    "temp_c",
    "dewpoint_c",
    "humidity",
    "wind_ms",
    "latitude",
    "longitude",
    "altitude",
]

READING_TYPE = T.StructType(
    [
        T.StructField("obs_date", T.DateType()),
        T.StructField("obs_hour", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(name, T.FloatType()) for name in MEASURES],
        T.StructField("latitude", T.FloatType()),
        T.StructField("longitude", T.FloatType()),
        T.StructField("altitude", T.FloatType()),
        T.StructField("region", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("wmo_code", T.StringType()),
        T.StructField("founded_year", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
    ]
)

# Fixed values.
SENTINELS = [-9999.0, -999.0, -99.0, 9999.0]
VALID_RANGES = {
    "temp_c": (-40.0, 50.0),
    "precip_mm": (0.0, 500.0),
    "pressure_mb": (800.0, 1100.0),
    "radiation_kjm2": (0.0, 5000.0),
    "humidity": (0.0, 100.0),
    "wind_ms": (0.0, 100.0),
}
HOURLY_FUNCTIONS = {
    "temp_c": ["mean", "min", "max", "std"],
    "precip_mm": ["sum", "max"],
    "pressure_mb": ["mean"],
    "humidity": ["mean", "min", "max"],
    "wind_ms": ["mean", "max"],
}
METRIC_LIMITS = {"rmse": 2.0, "mae": 1.5, "mape": 10.0, "r2": 0.8}


@dataclass(frozen=True)
class CleaningSettings:
    sentinels: tuple[float, ...] = tuple(SENTINELS)
    valid_ranges: dict[str, tuple[float, float]] = field(
        default_factory=lambda: dict(VALID_RANGES)
    )
    carry_limit: int = 6
    interpolate_limit: int = 24
    outlier_rows: int = 24
    outlier_width: float = 3.0


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in order, without ``exclude``."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def text_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]
