"""Reading policy files, rate cards, life grids and registries; writing reports."""
