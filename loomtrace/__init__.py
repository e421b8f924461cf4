"""A PySpark-native engine that explains SQL: lineage, diagnostics, locations, semantics."""
