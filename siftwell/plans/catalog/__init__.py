"""Query modules; each registers its queries when imported."""
