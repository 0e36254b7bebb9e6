"""Column expressions: grid arithmetic, projection, colour and name rules."""
