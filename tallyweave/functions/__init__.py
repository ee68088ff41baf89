"""Part of tallyweave."""
