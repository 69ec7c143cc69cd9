"""Analytics on bus-monitor recordings with Spark."""

__version__ = "0.2.0"
