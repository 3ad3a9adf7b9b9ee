"""Column functions: time parsing, rules and text."""
