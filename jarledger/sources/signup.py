"""O06 profile_provision: sign-up rows -> profile rows.

full_name = metadata 'full_name', else metadata 'name', else null; metadata
that is not valid JSON gives a null name (the profile is still created).
Works on a batch or a streaming frame (row-wise only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_provision(signups: DataFrame, meta: str = "raw_user_meta_data") -> DataFrame:
    m = F.col(meta)
    return signups.select(
        "id", "email",
        F.coalesce(F.get_json_object(m, "$.full_name"), F.get_json_object(m, "$.name")).alias("full_name"),
    )
