"""Reading guest files, writing tables, and the shared workspace."""
