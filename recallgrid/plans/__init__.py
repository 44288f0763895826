"""Named queries: importing the package fills the registry."""

from recallgrid.plans import catalog, lifecycle, reading, registry  # noqa: F401
