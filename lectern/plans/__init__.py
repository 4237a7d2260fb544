"""Plans for external sinks: what to synthesize, in which parts and order."""
