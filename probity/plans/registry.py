"""Named queries and, where SQL can say the same, the SQL they must agree with."""

QUERIES = {}
ORACLES = {}


def register(name, oracle=None):
    """Add a query ``(spark, directory) -> DataFrame`` under ``name``."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add
