"""Column functions: text, rules, time and geography."""
