"""Jobs to run from a command line; each module has a function that takes a session."""
