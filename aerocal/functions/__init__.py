from aerocal.functions.scalar import *  # noqa: F401,F403
from aerocal.functions.stats import *  # noqa: F401,F403
