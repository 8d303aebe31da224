"""Session and shared-storage helpers."""
