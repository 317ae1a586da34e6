"""Plans: operators bound to tables, and whole reports."""
