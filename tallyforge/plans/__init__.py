"""Projections of the tables and the queries over them."""
