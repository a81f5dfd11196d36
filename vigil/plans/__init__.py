"""The registered queries: operators applied to the driver's tables."""
