"""Jobs: runnable tasks on tables, each a function of a session and plain paths, with a command line."""
