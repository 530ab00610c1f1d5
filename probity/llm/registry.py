"""Named queries of this subpackage and, where SQL can say the same, their SQL."""

QUERIES = {}
ORACLES = {}


def register(name, oracle=None):
    """Add a query ``(spark, directory) -> DataFrame`` under ``name``."""
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark, directory, name):
    return spark.read.parquet(f"{directory}/{name}.parquet")
