"""Column builders (no UDFs): skill matching, categorical matches, vectors,
score arithmetic, value normalisation."""
