"""Fixed values that results depend on: aliases, family patterns, word lists, hints.

Fixed values. They are stated as plain data in their natural order; every
function that applies them takes them as a default argument.
"""

from __future__ import annotations

# Reviewed category aliases: raw key -> canonical key.
CATEGORY_ALIASES = {
    "third party supply chain risk": "third party and supply chain risk",
    "third party and vendor risk": "third party and supply chain risk",
    "supply chain and third party risk": "third party and supply chain risk",
    "insider and workforce related risk": "insider and workforce risk",
    "insider and human factor risk": "insider and workforce risk",
    "insider human factor risk": "insider and workforce risk",
    "regulatory and contractual exposure": "regulatory and legal exposure",
    "regulatory legal and contractual exposure": "regulatory and legal exposure",
    "regulatory compliance and legal exposure": "regulatory and legal exposure",
    "initial access vector": "initial access vectors",
    "extortion tactic": "extortion tactics",
}

# Category families, first matching pattern wins.
CATEGORY_FAMILIES = [
    ("Third-Party & Supply Chain", r"third party|supply chain|vendor|outsourc|msp|concentration"),
    ("Regulatory & Legal", r"regulat|legal|complian|contractual|litigat|sanction|privacy law"),
    (
        "Insider & Workforce",
        r"insider|workforce|human factor|credential|privileged access|student originated|social engineer",
    ),
    ("Initial Access", r"initial access|entry|intrusion|attack vector|exploitation"),
    (
        "Extortion & Impact",
        r"extortion|ransom|leak|exfiltrat|double|encryption|impact tactic|harassment",
    ),
    (
        "OT & Operational Disruption",
        r"\bot\b|ics|scada|operational technology|physical|safety|production|availability|disruption|outage|network",
    ),
    (
        "Data & IP Confidentiality",
        r"confidential|intellectual property|trade secret|source code|data theft|sensitive data|pii|phi",
    ),
    (
        "Business Interruption",
        r"business interruption|project delay|revenue|financial loss|liquidity",
    ),
]
DEFAULT_FAMILY = "Other"

# Disclosure and money patterns.
NEGATED_DISCLOSURE = (
    r"(?i)^\s*(not\s+(a\s+)?(publicly\s+|single\s+)*disclos|no\s+(publicly\s+)?disclos"
    r"|undisclosed|not\s+publicly\s+reported)"
)
USD_AMOUNT = r"(?i)\$\s?([\d,]+(?:\.\d+)?)\s*(billion|bn|million|mn|m|k|thousand)?"
USD_CEILING = 5e9
RANSOM_PAID = r"(?i)\bpaid\b|did pay|reportedly paid|payment of"
RANSOM_DEMANDED = r"(?i)\bdemand|ransom of|sought|asked for\b"
NOT_DISCLOSED_ANYWHERE = (
    r"(?i)not (publicly )?(disclosed|reported|available|known)|unknown|undisclosed|n/a"
)
NOT_DISCLOSED_PREFIX = (
    r"(?i)^(not (publicly )?(disclosed|reported|available|known)|unknown|undisclosed|n/a)"
)
PLACEHOLDER_GROUPS = ["not publicly disclosed", "unknown", "n/a", ""]
PLACEHOLDER_VICTIM = (
    r"(?i)^(not (publicly )?disclosed|unknown|undisclosed|n/?a|redacted|the company|confidential)$"
)

# Legal-form words dropped from organisation names.
COMPANY_SUFFIX = (
    r"\b(inc|inc\.|corp|corp\.|corporation|co|co\.|company|ltd|llc|l\.l\.c|plc|the|group"
    r"|holdings|international)\b"
)

# Display labels.
LABEL_ACRONYMS = ["ot", "it", "pii", "phi", "ip", "pos", "iot"]
LABEL_SMALL_WORDS = ["and", "of", "the"]

# Record gate.
ACCEPTED_INCIDENT_TYPES = ["ransomware", "data-extortion"]
UNKNOWN_INDUSTRY = "UNKNOWN"
INGEST_SOURCE = "sec/news"

# Posting defaults.
UNCLASSIFIED_SECTOR = "Unclassified"
UNCLASSIFIED_FILE_SECTOR = "(unclassified)"
SECTORS_WITHOUT_CLASS = ["Not Found", "(unclassified)", "Unclassified", ""]
POSTING_SOURCE = "ransomware.live"
SECTOR_NOTE = r"\s*\(ransomware\.live sector[^)]*\)"
FILING_ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"

# Question routing.
ANALYTICAL_QUESTION = (
    r"(?i)\b(how many|how much|count|number of|total|most active|top \d|top |busiest|by year"
    r"|per year|average|biggest|largest|costliest|coverage|disclos|how often|percentage|what share)\b"
)
RELATIONAL_QUESTION = (
    r"(?i)\b(both|also hit|shared|in common|but not|as well as|across (industries|sectors)|footprint)\b"
)
GROUP_INTENT = (
    r"(?i)\b(attack|incident|victim|hit|target|breach|group|gang|ransom|campaign|about|by|from)\b"
)
GROUP_ALIASES = {
    "blackcat": "alphv",
    "black cat": "alphv",
    "alphv/blackcat": "alphv",
    "noberus": "alphv",
    "lockbit 3.0": "lockbit3",
    "lockbit3.0": "lockbit3",
    "lockbit 2.0": "lockbit2",
    "lockbit3": "lockbit3",
    "lockbit2": "lockbit2",
}
ORDINARY_WORD_GROUPS = ["play", "money", "hunters", "cactus", "trigona"]
INDUSTRY_HINTS = {
    "healthcare": "Healthcare and Social Assistance",
    "finance": "Finance and Insurance",
    "financial": "Finance and Insurance",
    "manufacturing": "Manufacturing",
    "education": "Educational Services",
    "energy": "Energy and Utilities",
    "retail": "Retail Trade and Consumer Services",
    "government": "Public Administration (Government)",
    "public": "Public Administration (Government)",
    "technology": "Information Technology",
    "transportation": "Transportation and Warehousing",
    "construction": "Construction",
    "telecom": "Telecommunications",
    "agriculture": "Agriculture, Forestry, Fishing and Food Production",
    "hospitality": "Accommodation, Food Services, Arts and Entertainment",
}
SECTOR_HINTS = {
    "healthcare": "Healthcare",
    "finance": "Financial Services",
    "financial": "Financial Services",
    "manufacturing": "Manufacturing",
    "education": "Education",
    "energy": "Energy",
    "retail": "Consumer Services",
    "government": "Public Sector",
    "public": "Public Sector",
    "technology": "Technology",
    "transportation": "Transportation/Logistics",
    "construction": "Construction",
    "telecom": "Telecommunication",
    "agriculture": "Agriculture and Food Production",
    "hospitality": "Hospitality and Tourism",
    "business": "Business Services",
}
# Hits taken per node type, in merge order.
RETRIEVAL_QUOTAS = {"incident": 3, "industry": 2, "hazard": 2, "exposure": 2, "subcategory": 3}

# Property lengths kept on graph nodes.
CLIP = {
    "overview": 1200,
    "description": 800,
    "financial_impact": 600,
    "ransom": 400,
    "downtime": 600,
    "data_impact": 400,
    "summary": 900,
    "stat_value": 600,
    "global_stat_value": 800,
    "distinct": 700,
    "extortion_leverage": 500,
    "downtime_tolerance": 400,
    "theme_key": 120,
}
RAG_TEXT_CHARS = 2000

# Characters removed by strip(): the ASCII blanks and the Unicode space separators.
WHITESPACE = (
    " \t\n\r\x0b\x0c\u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
