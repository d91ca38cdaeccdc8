"""Column expressions and fitted constants shared by the operators."""
