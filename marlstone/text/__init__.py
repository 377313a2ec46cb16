"""Full-text search: tokens, stems, vectors, queries, ranking and headlines."""
