"""Column expressions and distributed statistics the operators are made of."""
