"""The queries: plans over the tables, registered by name."""


def all_queries() -> None:
    """Imports the modules whose queries register themselves."""
    from silverfold.plans import problems  # noqa: F401, I001
    from silverfold.plans import browse, culling, records, side, trees, vectors, where, streams  # noqa: F401
