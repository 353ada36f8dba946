"""Where rows come from: file trees, pattern files, stored tables and the given tables."""
