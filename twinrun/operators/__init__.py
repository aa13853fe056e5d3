"""DataFrame operators: multiset and schema comparison, output trees, text sections, definition files."""
