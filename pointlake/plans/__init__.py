"""Planning helpers: tables of a directory, shared scratch tables, size-checked broadcasts, graph components."""
