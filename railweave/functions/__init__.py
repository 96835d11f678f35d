"""Column expressions for clock times, places and names."""
