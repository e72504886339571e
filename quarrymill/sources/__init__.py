"""Where documents, registries and stores come from and go to."""
