"""The registered queries: inputs derived from the given tables, the operators on them, the SQL to compare."""
