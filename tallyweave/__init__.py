"""tallyweave: cross-document reconciliation as Spark plans."""
