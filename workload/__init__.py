"""The registered queries: a code corpus derived from the given tables, and one query per operator."""
