"""quillgraph: a PySpark-native engine for code-graph and corpus analytics."""
