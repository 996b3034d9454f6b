from reviewlens.functions.scalar import (  # noqa: F401
    days_since, display_name, fill_text, flag_label, helpfulness_parts,
    helpfulness_ratio, epoch_to_timestamp, review_length, unix_time,
    whole_days_since, row_hash, hash_uniform, nan_to_null,
)
