"""Named queries (``QUERIES``) and their oracle SQL (``ORACLE``, ``SMALL_ORACLE``)."""

from linearspark.registry.base import ORACLE, QUERIES, SMALL_ORACLE  # noqa: F401
from linearspark.registry import data  # noqa: F401,E402
from linearspark.registry import model  # noqa: F401,E402
from linearspark.registry import runs  # noqa: F401,E402
from linearspark.registry import training  # noqa: F401,E402
from linearspark.registry import jobs  # noqa: F401,E402
