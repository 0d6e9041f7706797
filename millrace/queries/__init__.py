"""All registered queries."""

from importlib import import_module

from millrace.queries.registry import ORACLES, QUERIES

for _module in ("sources", "sql", "metrics", "profiling", "exploring", "cleaning", "quality", "supervised", "clusters", "logs", "streams"):
    import_module(f"millrace.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]
