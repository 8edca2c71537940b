"""All queries of the citation operators: importing a module of plans registers its queries."""

from citelake.plans import citations, library, matching, records, rules, streams, updates

QUERIES = dict(citations.QUERIES)
ORACLES = dict(citations.ORACLES)
MODULES = (citations, library, matching, records, rules, streams, updates)
