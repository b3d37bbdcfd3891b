"""Column functions: every one stays in the JVM unless its docstring says otherwise."""
