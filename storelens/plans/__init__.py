"""The operator catalogue (see ``registry`` for the key -> builder map)."""
