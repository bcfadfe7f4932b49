"""Sample-level data exchange between the stages of a pipeline, on Spark DataFrames."""

from rowrelay.layout import Layout
from rowrelay.plans.exchange import Exchange

__all__ = ["Exchange", "Layout"]
