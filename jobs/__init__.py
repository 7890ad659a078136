"""Runnable jobs. Each has a function that takes a session and a config, a command line, and a config file beside it."""
