"""Column expressions (JVM-side, codegen-friendly) over SQL and plan text."""
