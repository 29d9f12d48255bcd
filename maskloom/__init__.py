"""Reversible document de-identification as DataFrame operators."""
