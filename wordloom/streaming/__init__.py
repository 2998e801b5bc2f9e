"""Row-local operators on a stream of new files."""
