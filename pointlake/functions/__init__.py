"""Column expressions; everything here stays in whole-stage code generation."""
