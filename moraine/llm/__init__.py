"""Operators for training data. Nothing else in the library imports this subpackage."""


def query_modules() -> list:
    """The modules that hold this subpackage's queries and their SQL."""
    from moraine.llm import queries

    return [queries]
