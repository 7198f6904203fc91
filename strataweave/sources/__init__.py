"""Where graphs come from: tables, git logs, source files and symbol indexes."""
