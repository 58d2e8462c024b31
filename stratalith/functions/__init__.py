"""Part of stratalith."""
