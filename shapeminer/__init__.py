"""Structure profiling of nested and semi-structured data on Spark."""

__version__ = "0.1.0"
