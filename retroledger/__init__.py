"""A Spark-native engine over committed row-change logs: assemble, index, invert, check, resolve, apply, and trace."""
