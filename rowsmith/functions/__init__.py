"""Column expressions: JSON text, coercion, validation rules."""
