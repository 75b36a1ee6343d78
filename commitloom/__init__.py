"""commitloom: a PySpark engine for corpora of version-control commits."""

__all__ = ["session", "schemas", "lineage"]
