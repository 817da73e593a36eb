"""Query plans built from the operators, one callable for each registered query."""
