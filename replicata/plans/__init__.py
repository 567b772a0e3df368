"""Physical helpers shared by the operators: written tables, sizes, range scans."""
