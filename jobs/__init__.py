"""Jobs that run the engine on tables as they grow. See README."""
