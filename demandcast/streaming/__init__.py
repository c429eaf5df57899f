"""Scoring rows as their files arrive."""
