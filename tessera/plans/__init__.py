"""Plans put together from operators, and the registered queries."""
