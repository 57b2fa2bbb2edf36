"""Queries of the engine, each with the SQL it is held against."""
