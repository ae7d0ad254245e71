"""Part of readq."""
