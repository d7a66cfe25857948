"""Named queries of the engine over the test tables, with the SQL they are checked against."""

from riacho.plans import corpus, market, problems, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (problems, corpus, tables, market):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
