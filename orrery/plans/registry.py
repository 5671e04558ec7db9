"""All registered queries of the core, with the SQL each is checked against."""

from orrery.plans import bills, corpus, derived, integrity, news, surface

MODULES = [integrity, news, bills, corpus, derived, surface]
FLAGSHIP = "c_pipeline"


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
