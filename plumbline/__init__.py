"""PySpark-native analytics with declared constraints, row-set semantics helpers and proof-carrying rewrites."""
