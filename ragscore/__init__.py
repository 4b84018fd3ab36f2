"""PySpark-native evaluation of retrieval-augmented generation, and generation of the benchmarks for it."""
