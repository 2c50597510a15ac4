"""Column expressions: money, labels, number coercion and text."""
