"""Part of lexiweave: sources."""
