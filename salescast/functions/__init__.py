"""Column expressions: calendar, holidays, numbers, forecast errors."""
