"""Column functions: path predicates, ignore rules, import resolution and display values."""
