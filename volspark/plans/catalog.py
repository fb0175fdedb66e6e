"""All queries of the engine with their DuckDB SQL."""

from volspark.plans import image_queries, voxel_queries

QUERIES = voxel_queries.QUERIES | image_queries.QUERIES
ORACLE_SQL = voxel_queries.ORACLE_SQL | image_queries.ORACLE_SQL
