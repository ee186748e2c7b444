"""Column functions: text, vectors, JSON, LaTeX and small scalars.  All stay in the JVM."""
