"""Registered queries and their oracle SQL."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str = None):
    """Registers fn(spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
