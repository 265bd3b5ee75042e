"""All queries and their SQL."""

from claimloom.plans import catalogue, documents  # noqa: F401  (importing documents puts its queries into the catalogue)

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
