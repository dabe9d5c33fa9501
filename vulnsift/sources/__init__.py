from vulnsift.sources.tables import table, TABLES  # noqa: F401
