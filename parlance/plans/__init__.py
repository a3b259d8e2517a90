"""Composed jobs and the registered queries with their checking SQL."""
