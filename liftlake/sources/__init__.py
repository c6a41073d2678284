"""Table views, catalogs and file sinks."""
