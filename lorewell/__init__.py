"""lorewell: a Spark-first engine for building, searching and checking a citeable knowledge base."""

__version__ = "0.1.0"
