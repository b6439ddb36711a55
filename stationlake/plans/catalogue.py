"""All registered queries."""

from stationlake.plans import (  # noqa: F401
    aggregate_queries,
    cleaning_queries,
    feature_queries,
    forecast_queries,
    source_queries,
    split_queries,
    stream_queries,
)
from stationlake.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
