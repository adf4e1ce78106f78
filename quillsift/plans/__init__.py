"""The engine's face: verbs over databases, tables and documents, and the routing of requests to them."""
