"""Screening by a small formula language."""
