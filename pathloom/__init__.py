"""A PySpark engine for multi-hop question answering over graphs, and for text corpora."""
