"""DataFrame operators: resolve, normalize, classify, families, timeline, profiles,
insights, flows, ranking."""
