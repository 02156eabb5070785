"""Part of lexiweave: plans."""
