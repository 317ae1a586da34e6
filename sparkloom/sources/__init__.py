"""Sources: Python files, commit logs, manifests."""
