from cases import documents  # noqa: F401
