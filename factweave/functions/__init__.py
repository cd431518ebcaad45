"""Column expressions: pure Column -> Column functions that stay inside code generation."""
