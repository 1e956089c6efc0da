"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import registry
from . import answer_queries as _answers  # noqa: F401
from . import source_queries as _source  # noqa: F401
from . import store_queries as _store  # noqa: F401
from . import structure_queries as _structure  # noqa: F401
from . import text_queries as _text  # noqa: F401  (importing registers)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
