"""End-to-end jobs composed from the operators, and the catalogue of registered queries."""
