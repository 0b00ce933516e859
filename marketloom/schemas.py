"""Record shapes shared by the operators. A null price means "not on the page"."""

TIER = (
    "struct<model_or_tier_name:string,input_price_per_m_tokens:double,output_price_per_m_tokens:double,"
    "cache_read_price_per_m_tokens:double,context_window_tokens:bigint,fixed_monthly_price:double,"
    "base_price_monthly:double,seat_price_monthly:double,currency:string,notable_features:array<string>>"
)

# A model's answer about a page. Prices are read as text, for models that write "$2.50 / 1M".
ANSWER = (
    "company_name string, product_name string, enterprise_terms_mentioned boolean, rate_limits_summary string, "
    "extraction_confidence double, citation_text string, pricing_tiers array<struct<model_or_tier_name:string,"
    "input_price_per_m_tokens:string,output_price_per_m_tokens:string,cache_read_price_per_m_tokens:string,"
    "context_window_tokens:bigint,fixed_monthly_price:string,base_price_monthly:string,seat_price_monthly:string,"
    "currency:string,notable_features:array<string>>>"
)

SOURCE = (
    "id string, company_name string, target_url string, category string, preferred_tier string, "
    "selector_hints array<string>, check_frequency string, enabled boolean"
)

RAW_DOC = (
    "pipeline_id string, url string, domain string, status_code int, content_markdown string, "
    "content_hash string, content_length int, scraped_at timestamp, scrape_tier_used string, "
    "pii_redacted boolean, robots_compliant boolean"
)

AUDIT = (
    "audit_id string, pipeline_id string, timestamp timestamp, source_url string, robots_checked boolean, "
    "robots_allowed boolean, crawl_delay_applied_seconds double, pii_scrubbed_count int, "
    "login_bypass_attempted boolean, compliance_status string, agent_version string"
)

RECORD = (
    "pipeline_id string, company_name string, product_name string, source_url string, "
    f"pricing_tiers array<{TIER}>, enterprise_terms_mentioned boolean, rate_limits_summary string, "
    "extraction_confidence double, citation_text string, extracted_at timestamp"
)

DELTA = (
    "competitor_name string, product_name string, delta_type string, metric_name string, "
    "old_value string, new_value string, percentage_change double, strategic_severity string"
)

INSIGHT = (
    "pipeline_id string, category string, title string, rationale string, actionable_next_step string, "
    "corroborating_sources array<string>, corroboration_count int, created_at timestamp"
)

RUN = (
    "pipeline_id string, started_at timestamp, completed_at timestamp, target_vertical string, status string, "
    "sources_count int, records_extracted int, report_path string, execution_metrics map<string,string>"
)

REPORT = (
    "report_id string, pipeline_id string, title string, generated_at timestamp, target_vertical string, "
    "executive_summary string, markdown_content string, citations array<string>"
)

EVENT = "pipeline_id string, agent string, event string, timestamp timestamp, data map<string,string>"

ACTION = (
    "timestamp timestamp, agent string, action string, status string, source_url string, error string, "
    "metadata map<string,string>"
)

# The driver's events table, as read by the streams.
EVENTS_TABLE = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
