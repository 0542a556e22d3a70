from . import adapter, readers, sinks  # noqa: F401
