"""A PySpark-native engine for questions about how code hangs together and what a change can reach."""
