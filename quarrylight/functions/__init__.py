"""Column functions: classifiers, extractors, parsers."""
