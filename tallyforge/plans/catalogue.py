"""All queries of the core and their SQL."""

from __future__ import annotations

from tallyforge.plans import claims, corpus, criteria, documents, judging, periods, rules, scoring, tables, verdicts

MODULES = [periods, documents, claims, rules, criteria, scoring, judging, corpus, tables, verdicts]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
