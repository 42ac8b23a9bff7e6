"""As-of feature operators, joins and the identity graph."""
