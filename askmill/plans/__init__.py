"""Query registry and shared planning helpers."""
