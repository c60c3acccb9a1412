"""lexmill: text retrieval, verification and corpus statistics as Spark plans."""

__version__ = "0.1.0"
