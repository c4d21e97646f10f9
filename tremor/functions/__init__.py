"""Column functions: paths and globs, URLs and routes, text of files."""
