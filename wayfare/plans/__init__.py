"""Multi-operator plans: the analysis registry, feature building, modelling."""
