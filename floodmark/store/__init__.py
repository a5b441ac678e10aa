"""The append-only store of runs, results, causes, key events and files."""
