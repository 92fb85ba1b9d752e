"""Operators for large training-text corpora; nothing else in Sieveline imports them."""
