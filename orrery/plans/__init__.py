"""The registered queries: operators applied to the supplied star schema."""
