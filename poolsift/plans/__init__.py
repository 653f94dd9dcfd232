"""Registered queries, their input views, and the selection loop."""
