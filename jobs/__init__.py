"""Jobs that run on a schedule. Each is a function of a session, paths and settings, and a command line around it."""
