"""Registered queries: each operator on the test tables, with its SQL counterpart."""
