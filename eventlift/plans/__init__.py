"""The study as a chain of tables, and the registered queries."""
