"""Rule catalogues: patterns, severities and gates as data."""
