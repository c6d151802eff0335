"""Registered queries and their SQL: importing the package registers those of all its modules in the tables of ``catalog``."""

from lodestone.queries import assessment, catalog, packages, structure  # noqa: F401
