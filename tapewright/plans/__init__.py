"""Registered queries, their SQL, and the views they run over."""
