"""All registered queries and their SQL."""

from corvane.plans import ingest, retrieval, service, timed

QUERIES: dict = ingest.QUERIES | retrieval.QUERIES | service.QUERIES | timed.QUERIES
ORACLES: dict = ingest.ORACLES | retrieval.ORACLES | service.ORACLES | timed.ORACLES
