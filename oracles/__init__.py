"""Independent DuckDB SQL for the registered queries, over the given tables."""

from oracles import catalog, graphs, ingest


def all_oracles() -> dict[str, str]:
    return {**ingest.ORACLES, **catalog.ORACLES, **graphs.ORACLES}
