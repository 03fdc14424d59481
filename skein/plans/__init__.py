"""Registered queries with their oracles, by plane."""

from . import analytics, columns, indexes, prepare, retrieval, streams, transcripts, understand

PLANES = (analytics, retrieval, indexes, prepare, transcripts, streams, understand, columns)
QUERIES = {name: query for plane in PLANES for name, query in plane.QUERIES.items()}
SQL = {name: sql for plane in PLANES for name, sql in plane.SQL.items()}
