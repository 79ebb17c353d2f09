"""Empty: the engine's inputs are bounded, and adaptive sampling is a driver loop over batch jobs."""
