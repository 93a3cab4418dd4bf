"""Connected components of a link table: the library's own, under the name this subpackage uses."""

from lettergraph.operators.links import components  # noqa: F401
