"""Column functions: validity, per-pixel transforms, layer algebra, bit transports."""
