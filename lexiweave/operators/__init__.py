"""Part of lexiweave: operators."""
