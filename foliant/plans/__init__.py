"""Query definitions; importing this package registers them all."""

from foliant.plans import q_chunks  # noqa: F401, I001  the flagship query comes first
from foliant.plans import q_aggregates, q_files, q_joins, q_layout, q_more, q_rows, q_rules, q_text  # noqa: F401
