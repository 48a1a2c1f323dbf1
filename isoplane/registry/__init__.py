"""Every registered query with, where one exists, its SQL for comparison."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)`` and its SQL under a name."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load():
    """Import the query modules so that they register themselves."""
    from isoplane.registry import designs, models, tables  # noqa: F401
    return QUERIES, ORACLES
