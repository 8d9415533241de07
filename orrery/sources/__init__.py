"""Reading the catalogs and keeping them as tables."""
