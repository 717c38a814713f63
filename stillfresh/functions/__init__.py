"""Column expressions: names, identities, displays."""
