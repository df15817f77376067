"""Column expressions: text in, text or structs out, no Python in the plan."""
