"""Plans: configuration, the windowed tier, the stateful fold."""
