"""Jobs that can be run from the command line; see each module."""
