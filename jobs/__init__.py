"""Runnable jobs over the library: each a function that takes a session, and a command line around it."""
