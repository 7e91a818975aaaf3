"""Sources and sinks: message views, state snapshots, audit logs."""
