"""Column functions: Column in, Column out, all of them built-in Spark expressions."""

from tagloom.functions.binding import *  # noqa: F401,F403
from tagloom.functions.jsontext import *  # noqa: F401,F403
from tagloom.functions.numeric import *  # noqa: F401,F403
from tagloom.functions.text import *  # noqa: F401,F403
