"""Column functions: words, stems and date texts."""
