"""Column functions: pure expressions, evaluated inside the JVM."""

from dossier.functions.keys import (
    apply_aliases,
    blank_to_null,
    canonical_name,
    clean_country,
    company_key,
    family_of,
    has_key,
    hash16,
    host_of,
    incident_id,
    is_placeholder_group,
    is_placeholder_victim,
    is_url,
    let,
    norm_key,
    org_key,
    posting_id,
    raw_key,
    sector_key,
    sector_name,
    sector_slug,
    slug,
    split_groups,
    strip,
    text,
    year_of,
)
from dossier.functions.money import (
    fmt_usd,
    heat_bucket,
    is_demanded,
    is_disclosed,
    is_not_disclosed_any,
    is_not_disclosed_prefix,
    is_paid,
    money_struct,
    parse_usd,
    pct,
)
from dossier.functions.records import (
    filer_name,
    filing_url,
    insights_view,
    richness,
    size_of,
    with_defaults,
)
from dossier.functions.texts import (
    clean_payload,
    clip,
    de_dash,
    display_label,
    rag_text,
    short_name,
    strip_html,
)

__all__ = [name for name in dir() if not name.startswith("_")]
