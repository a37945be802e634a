"""Plans made of several operators, the plug-in registry and the query catalogue."""
