from wharf.functions.casts import *  # noqa: F401,F403
from wharf.functions.periods import *  # noqa: F401,F403
