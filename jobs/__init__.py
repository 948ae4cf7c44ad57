"""Jobs over given tables: each has a command line and a settings file, and its work in a function that takes a session."""
