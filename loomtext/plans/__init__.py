from loomtext.plans import catalogue, catalogue_more, catalogue_sources  # noqa: F401  all three register their queries
