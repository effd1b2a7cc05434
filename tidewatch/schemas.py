"""Schemas of the driver tables and of the monitoring tables.

Reading with a given schema needs no job to look at file footers.
"""

# Driver tables.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}

# Monitoring tables.  Labels, tags and thresholds are JSON text with sorted keys.
METRICS = (
    "id bigint, system_id string, name string, value double, unit string, labels string, ts timestamp_ntz"
)
SYSTEMS = (
    "id string, name string, description string, type string, tags string, endpoints string, "
    "thresholds string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
ALERTS = (
    "id string, system_id string, name string, description string, severity string, status string, "
    "metric_name string, metric_value double, threshold double, operator string, labels string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, resolved_at timestamp_ntz"
)
RULES = (
    "id string, system_id string, name string, description string, enabled boolean, metric_name string, "
    "operator string, threshold double, severity string, duration_s int, labels string, channels string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
