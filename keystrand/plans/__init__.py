"""Engine settings and the registered queries."""
