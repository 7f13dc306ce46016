"""The registry of queries and their SQL oracles."""

from __future__ import annotations

from gradeloom.functions import checks, paths
from gradeloom.operators import briefs, clusters, corpus, gate, graphs, grouped, linear, ranks, refresh, similarity, sinks, source, vectors, walks
from gradeloom.plans import authoring, domain, relational
from gradeloom.plans.evidence import query, rendered
from gradeloom.sources import fixtures
from gradeloom.streaming import mastery

_ALL = {**relational.SQL, **domain.SQL, **authoring.SQL}
_SQL, _DUCK = ({k: v if isinstance(v, str) else v[i] for k, v in _ALL.items()} for i in (0, 1))


def queries() -> dict:
    """SQL queries by name, then those that need grouped Python functions or a stream, and operators in place of a SQL form that does not scale."""
    found = {name: query(sql) for name, sql in _SQL.items()}
    for part in (grouped, source, briefs, clusters, refresh, fixtures, mastery, checks, similarity, sinks, graphs, ranks, gate, paths, linear, vectors, walks, corpus):
        found |= part.queries()
    return found


def oracle_sql() -> dict[str, str]:
    written = {"snk9_attainment_csv": refresh.ATTAINMENT} | mastery.oracle_sql()
    return {name: rendered(sql, duck=True) for name, sql in (_DUCK | written | similarity.oracle_sql() | paths.oracle_sql() | linear.oracle_sql() | gate.oracle_sql() | graphs.oracle_sql() | ranks.oracle_sql(domain._STEPS, domain._ADJ)).items()} | sinks.oracle_sql(rendered)
