"""Column expressions and the SQL functions registered from them."""
