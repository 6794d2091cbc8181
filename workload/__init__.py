"""Registered queries: each runs an operator over whole tables, with equivalent SQL where SQL can express it."""
