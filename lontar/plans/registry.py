"""All registered queries of the core, with their oracle SQL where SQL can express them."""

from lontar.plans import evaluation, experiments, geo, ingest, quality, retrieval, search, text

MODULES = (retrieval, search, text, evaluation, quality, ingest, experiments, geo)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
