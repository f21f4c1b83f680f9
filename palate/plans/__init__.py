"""Compositions of operators: the driver's queries and the build of the lists."""
