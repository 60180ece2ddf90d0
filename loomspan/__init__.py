"""loomspan: a PySpark-native engine for curating, mixing and evaluating large corpora."""
