"""All queries of the core and their DuckDB counterparts."""

from tapeloom.plans import market, problems, screens, similar, studies, summaries

_MODULES = (problems, market, studies, screens, similar, summaries)
FLAGSHIP = "amount_leaders"
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
