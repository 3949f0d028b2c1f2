"""Document analytics on Spark: copied passages, writing style, and the preparation of large text collections."""

__version__ = "0.2.0"
