"""Search requests and the registered queries."""
