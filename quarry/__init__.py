"""A PySpark engine for permission-aware content search, content scans and corpus audits."""
