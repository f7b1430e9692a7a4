"""End-to-end jobs over the operators, fixture derivations and registered queries."""
