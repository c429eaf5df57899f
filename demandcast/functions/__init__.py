"""Column expressions: pure functions from columns to columns."""
