"""Relational building blocks: projections, guards, joins, latest-row, paging, loads."""
