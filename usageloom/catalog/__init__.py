"""Runnable catalogue: each operator on tables derived from the driver's data."""


def load():
    """Import all query modules and return the registry."""
    from usageloom.catalog import registry
    from usageloom.catalog import (  # noqa: F401
        rollups,
        cache,
        views,
        sessions,
        state,
        ingest,
        judgments,
        streams,
    )

    return registry
