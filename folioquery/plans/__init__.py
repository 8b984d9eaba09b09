"""Plans that chain operators: from pages to records, from a scoring grid to reports, and incremental runs."""
