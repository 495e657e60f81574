"""Registered queries (imports each catalog section)."""

from . import catalog_clean  # noqa: F401
from . import catalog_features  # noqa: F401
from . import catalog_profile  # noqa: F401
from . import catalog_ratios  # noqa: F401
from . import catalog_sampling  # noqa: F401
from . import catalog_targets  # noqa: F401
from . import catalog_meta  # noqa: F401
from . import catalog_learners  # noqa: F401
from . import catalog_extra  # noqa: F401
from . import catalog_more  # noqa: F401
