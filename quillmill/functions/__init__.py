"""Column functions (JVM-side unless a docstring says otherwise)."""
