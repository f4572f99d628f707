"""Column functions: text, paths, content markers, severities."""
