"""Registered queries: name to (spark, sf_dir) function, and name to equivalent SQL."""

from . import clouds, deliveries, imagery, mosaics, objects, shapes, tracks, values

MODULES = [tracks, imagery, objects, mosaics, deliveries, shapes, clouds, values]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
