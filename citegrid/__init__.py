"""citegrid: a PySpark analytics engine for graphs of cited facts and their source texts."""

__version__ = "0.1.0"
