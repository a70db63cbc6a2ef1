"""End-to-end jobs over the operators, and the tables derived from the benchmark data set."""
