"""Lead fixtures on the star schema and the registered queries."""
