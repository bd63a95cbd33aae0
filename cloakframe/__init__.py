"""A PySpark-native engine for reversible, fail-closed pseudonymization of log and document data."""
