"""corpusloom: a PySpark engine for building, cleaning and auditing text corpora."""

__version__ = "0.1.0"
