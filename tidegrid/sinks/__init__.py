"""Writers of price tables, derived tables and reports."""
