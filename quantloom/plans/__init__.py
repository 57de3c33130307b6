"""Registered queries over the engine's operators."""


def load() -> None:
    """Import the modules that register queries."""
    from quantloom.plans import analysis, delta, desk, indicators, markets, metrics, models, panels, risk  # noqa: F401
