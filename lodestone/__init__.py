"""Document, link and event-log analytics on Spark."""

__version__ = "0.2"
