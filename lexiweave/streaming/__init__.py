"""Part of lexiweave: streaming."""
