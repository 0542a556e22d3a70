from .score_stream import start_scoring  # noqa: F401
