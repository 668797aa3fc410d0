from strata.functions.keys import (
    jaccard_two_sided,
    key_level,
    key_merge,
    larger_second,
    path_prepend,
    seed_slot,
    shorter_path,
    slot_merge,
    slot_update,
    state_update,
    was_clustered,
)
from strata.functions.text import (
    created_at_ms,
    day_offset_ms,
    escape_delimiters,
    lenient_boolean,
    lenient_millis,
    unescape_delimiters,
)

__all__ = [
    "created_at_ms",
    "day_offset_ms",
    "escape_delimiters",
    "jaccard_two_sided",
    "key_level",
    "key_merge",
    "larger_second",
    "lenient_boolean",
    "lenient_millis",
    "path_prepend",
    "seed_slot",
    "shorter_path",
    "slot_merge",
    "slot_update",
    "state_update",
    "unescape_delimiters",
    "was_clustered",
]
