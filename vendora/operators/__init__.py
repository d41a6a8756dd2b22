"""Reusable distributed operators (survey section 2.2)."""
