"""Tables derived from the given data, and the registered queries."""
