"""Yearly files that arrive one by one: the roll-up of the raw panel as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.panel import Config, raw_panel
from ..sources.trade import TRADE_SCHEMA, YEARLY, rename


def stream_trade(spark: SparkSession, path: str, yearly: str = YEARLY) -> DataFrame:
    return rename(spark.readStream.schema(TRADE_SCHEMA).option("header", True).option("pathGlobFilter", yearly).csv(path))


def stream_panel(trade: DataFrame, cfg: Config) -> DataFrame:
    """Running sums by (year, good, importer, exporter), for output mode update or complete."""
    return raw_panel(trade, cfg.with_(agg_level="hs4"))
