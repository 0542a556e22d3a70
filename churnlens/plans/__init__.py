from .catalog import all_queries  # noqa: F401
from .oracle import all_oracle  # noqa: F401
