"""Driver-side planning: windows, chunks, lattices, cameras, pages. No DataFrames."""
