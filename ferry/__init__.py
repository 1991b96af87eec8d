"""ferry: move tables, keep them in step and prove they match, on Spark."""

__version__ = "0.1.0"
