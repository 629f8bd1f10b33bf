"""Column expressions (all JVM-side, codegen friendly)."""
