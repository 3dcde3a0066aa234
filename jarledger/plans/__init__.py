"""Query plans: the registered queries, their SQL oracles, and composite views."""
