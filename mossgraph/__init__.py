"""mossgraph: graph-reservoir text classification and corpus analytics on Spark."""
