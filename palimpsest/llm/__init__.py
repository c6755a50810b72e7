"""Operators that prepare training text: each module holds one of them; ``registry`` lists their queries and SQL."""
