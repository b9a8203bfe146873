"""DataFrame-level operators: what the dialect's statements are made of, usable without SQL."""
