"""DataFrame operators: inspection, policy evaluation, tenant store."""
