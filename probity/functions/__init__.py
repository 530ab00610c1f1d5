"""Column expressions, texts and fixed values shared by the operators."""
