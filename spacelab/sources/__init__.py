"""Where points come from: generators' orbits, and integral columns of tables."""
