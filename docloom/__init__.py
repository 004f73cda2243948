"""docloom: document-corpus and retrieval analytics as PySpark DataFrames."""

__version__ = "0.1.0"
