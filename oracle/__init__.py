"""SQL counterparts of the registered queries, for a second engine."""
