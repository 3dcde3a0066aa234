"""Model schemas (Spark DDL) of the ledger tables."""

PROFILES = "id BIGINT, full_name STRING, email STRING, home_currency STRING, language STRING"
BOX_TEMPLATES = "id BIGINT, name STRING, total_amount INT, currency STRING, grid_config ARRAY<INT>"
USER_BOXES = (
    "id BIGINT, user_id BIGINT, template_id BIGINT, name STRING, currency STRING, "
    "current_amount DECIMAL(12,2), target_amount DECIMAL(12,2), is_archived BOOLEAN, "
    "crossed_out_indices ARRAY<INT>, created_at TIMESTAMP_NTZ"
)
TRANSACTIONS = "id BIGINT, box_id BIGINT, amount DECIMAL(12,2), note STRING, date TIMESTAMP_NTZ"
RATES = "base STRING, quote STRING, rate DOUBLE"
OP_LOG = (
    "op_id BIGINT, ts TIMESTAMP_NTZ, device STRING, box_id BIGINT, op STRING, "
    "amount DECIMAL(12,2), arg STRING, failed BOOLEAN"
)
# One queued device item, as the device serialises it.
QUEUE_ITEM = "action STRING, boxId BIGINT, amount DECIMAL(12,2), note STRING, date STRING"

MONEY = "DECIMAL(12,2)"
# Sums and balances are output in this type: 16 integer digits, and at most
# 18 digits keeps a DECIMAL long-backed in Spark's row format (wider ones are
# BigDecimal objects per value, markedly slower in every projection).
MONEY_OUT = "DECIMAL(18,2)"
