"""tilewright: PySpark operators for labelled patch-embedding tables."""

__version__ = "0.1.0"
