"""refgraph: reference-graph analytics as PySpark DataFrame operators."""
