"""lanewise: road-traffic analytics over tracked-object tables, written as Spark DataFrame operators."""

__version__ = "0.1.0"
