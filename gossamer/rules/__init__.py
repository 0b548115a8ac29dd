"""Rules of one's own: a registry of named functions from tables to findings, which an audit runs."""
