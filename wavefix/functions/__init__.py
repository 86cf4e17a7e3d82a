"""Part of the wavefix engine."""
