"""Text rules as column expressions and plain functions."""
