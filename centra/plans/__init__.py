"""Run-log analytics and the registered queries."""
