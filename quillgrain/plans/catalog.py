"""A catalogue of queries and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    """Collects queries by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable:
        """Registers a query and, where there is one, its SQL."""

        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return put
