"""Sources and sinks: table bindings, rate feeds, device queue dumps,
snapshots, template seeding and sign-up provisioning."""
