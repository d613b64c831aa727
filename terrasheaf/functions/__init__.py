"""Column builders; all stay inside Catalyst."""
