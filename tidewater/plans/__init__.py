"""Named queries over concrete tables, each with its SQL where SQL can express it."""

from importlib import import_module

from tidewater.plans.registry import ORACLE, QUERIES

for _name in ("time", "segments", "statistics", "cohorts", "catalogs", "paired", "tasks", "features", "audits", "evidence", "stages", "checks", "publishing", "reports", "relational", "reviews", "regions", "trajectories", "late", "scopes", "metrics", "releases", "recordings", "batches"):
    import_module(f"tidewater.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
