from .scalar import *  # noqa: F403
from .scalar import __all__  # noqa: F401
