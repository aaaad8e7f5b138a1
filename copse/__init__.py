"""copse: gradient boosting, scoring and explanation expressed as Spark plans."""

__version__ = "0.1.0"
