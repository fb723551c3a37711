"""Word lists, event lists and thresholds that results depend on.

They are default arguments; every operator takes its own lists instead.
"""

from __future__ import annotations

# --- Fixed values: lexicon categories -------------------------------------------------------

CLIMATE_TERMS = [
    "climate", "climate change", "clean energy", "renewable", "renewable energy",
    "decarbonization", "carbon", "greenhouse gas", "net zero", "EV", "electric vehicle",
    "hydrogen", "solar", "wind", "battery", "grid",
]

POLICY_TERMS = [
    "policy", "regulation", "tax credit", "subsidy", "grant", "incentive", "Congress", "DOE",
    "Department of Energy", "EPA", "Treasury", "IRS", "White House", "legislation",
    "Inflation Reduction Act", "IRA", "OBBBA", "One Big Beautiful Bill", "Big Beautiful Bill",
    "reconciliation", "phase-out", "phase out",
]

UNCERTAINTY_TERMS = [
    "uncertain", "uncertainty", "unclear", "unpredictable", "unknown", "question", "doubt",
    "risk", "risky",
]

IMPLEMENTATION_TERMS = [
    "delay", "delayed", "delays", "pending", "awaiting", "timeline", "schedule", "slow",
    "slower", "slowly", "backlog", "bottleneck", "guidance", "guideline", "clarify",
    "clarification", "interpret", "interpretation", "rulemaking", "rule-making",
    "comment period", "processing", "process", "application", "applications", "approval",
    "approvals", "review", "reviewing", "finalize", "finalizing", "rollout", "roll-out",
    "phase-in", "phasing in", "effective date",
]

REVERSAL_TERMS = [
    "rollback", "roll back", "repeal", "repealed", "reverse", "reversal", "revoke", "rescind",
    "rescission", "withdraw", "withdrawal", "eliminate", "elimination", "abolish", "dismantle",
    "terminate", "cancel", "overturn", "overturned", "invalidate", "strike down", "scrap",
    "gut", "kill",
]

UPSIDE_TERMS = [
    "expand", "expansion", "extend", "extension", "strengthen", "enhance", "increase", "boost",
    "accelerate", "ramp up", "scale up", "invest", "investment", "fund", "funding", "support",
    "commit", "commitment", "pledge", "allocate", "allocation", "mandate", "require",
    "requirement", "introduce", "launch", "establish", "create", "implement", "implementation",
    "enact", "pass", "passed", "adopt", "adopted", "incentivize", "subsidize", "incentive",
    "subsidy", "credit", "rebate", "grant", "ambitious", "aggressive", "bold", "target", "goal",
    "transition", "transform", "transformation", "modernize", "upgrade", "advance", "progress",
    "net-zero", "net zero", "carbon neutral", "carbon-neutral", "decarbonize",
    "decarbonization", "clean energy", "renewable",
]

REGIME_IRA_TERMS = [
    "Inflation Reduction Act", "clean energy tax credit", "clean energy tax credits", "369",
    "45X", "45V", "45Q", "30D", "48E",
]

REGIME_OBBBA_TERMS = [
    "OBBBA", "One Big Beautiful Bill", "Big Beautiful Bill", "reconciliation bill",
]

TRADE_TERMS = [
    "trade", "tariff", "tariffs", "import", "export", "USMCA", "NAFTA", "WTO", "trade war",
    "trade policy", "trade agreement", "trade deal", "trade talks",
]

MONETARY_TERMS = [
    "Federal Reserve", "Fed", "interest rate", "interest rates", "monetary policy", "inflation",
    "deflation", "quantitative easing", "QE", "tightening", "dovish", "hawkish", "FOMC",
    "rate hike", "rate cut",
]

# --- Fixed values: outlets and wire services ------------------------------------------------

NEWS_OUTLETS = [
    "Financial Times", "Wall Street Journal", "New York Times", "Washington Post", "Reuters",
    "Bloomberg", "Politico", "The Economist",
]

BENCHMARK_OUTLETS = [
    "New York Times", "Wall Street Journal", "Boston Globe", "Chicago Tribune",
    "Los Angeles Times", "Miami Herald", "Tampa Bay Times", "USA Today",
]

WIRE_SERVICES = [
    "associated press", "ap", "reuters", "afp", "agence france-presse",
    "agence france presse", "united press international", "upi",
]

# --- Fixed values: deals --------------------------------------------------------------------

DEAL_COLUMNS = [
    "Deal ID", "Companies", "Company ID", "Deal Date", "Announced Date", "Deal Size",
    "Deal Size Status", "Deal Type", "Deal Type 2", "Deal Type 3", "VC Round", "Series",
    "Primary Industry Sector", "Primary Industry Group", "Verticals", "Keywords",
    "Deal Status", "Current Financing Status", "HQ Location", "Company State/Province",
    "Company Country/Territory/Region", "Year Founded",
]

DEAL_STAGES = {
    "Seed Round": "Seed",
    "Angel (individual)": "Seed",
    "Early Stage VC": "Early",
    "Later Stage VC": "Late",
}

DEAL_MIN_DATE = "2008-01-01"

# --- Fixed values: sector analysis ----------------------------------------------------------

EXCLUDED_SECTORS = ["Others"]
HIGH_EXPOSURE = 6
LOW_EXPOSURE = 3
RECENT_START = "2021-01-01"
FULL_START = "2008-01-01"
MIN_OBSERVATIONS = 24
MAX_LAG = 12

# --- Fixed values: base period of the outlet indices ----------------------------------------

OUTLET_BASE = ("2021-01", "2024-10")

# --- Fixed values: events and the reaction expected of the index ------------------------------

CALENDAR_EVENTS = [
    ("2022-07", "Manchin withdraws support", "spike"),
    ("2022-08", "IRA signed into law", "drop"),
    ("2024-11", "Trump wins election", "spike"),
    ("2025-01", "Trump executive orders", "spike"),
]

REGISTERED_EVENTS = [
    ("2021-01", "Biden inauguration", "decrease"),
    ("2022-07", "Manchin announces support for IRA", "spike_then_drop"),
    ("2022-08", "IRA signed into law", "decrease"),
    ("2023-01", "Treasury guidance delays", "increase"),
    ("2024-01", "Election year begins", "increase"),
    ("2024-11", "Trump wins election", "spike"),
    ("2025-01", "Trump inauguration + executive orders", "spike"),
    ("2025-02", "OBBBA introduced", "spike"),
]

REPORT_EVENTS = [
    ("2021-01", "Biden inauguration", "decrease"),
    ("2022-08", "IRA signed", "decrease"),
    ("2023-01", "Treasury guidance delays", "increase"),
    ("2024-01", "Election year begins", "increase"),
    ("2024-11", "Trump wins", "spike"),
    ("2025-01", "Trump inauguration", "spike"),
    ("2025-02", "OBBBA introduced", "spike"),
]

# (first day, day after the last, name); an open end is None
REGIMES = [
    ("2009-01-20", "2017-01-20", "obama"),
    ("2017-01-20", "2021-01-20", "trump_1"),
    ("2021-01-20", "2025-01-20", "biden"),
    ("2025-01-20", None, "trump_2"),
]

# (date, kind); a transition lasts TRANSITION_MONTHS
TRANSITIONS = [
    ("2017-01-20", "transition_negative"),
    ("2021-01-20", "transition_positive"),
    ("2025-01-20", "transition_negative"),
]
TRANSITION_MONTHS = 6

# --- Fixed values: success criteria (name, metric, lower bound, upper bound) ------------------

CRITERIA = [
    ("keyword_dropping", "correlation_with_baseline", 0.95, None),
    ("outlet_robustness", "correlation_with_baseline", 0.80, None),
    ("llm_validation", "correlation_keyword_vs_llm", 0.90, None),
    ("base_period", "correlation_across_periods", 0.99, None),
    ("placebo", "correlation_with_placebo", None, 0.70),
    ("decomposition", "impl_reversal_correlation", 0.40, 0.80),
    ("event_validation", "event_direction_accuracy", 0.75, None),
]

# --- Fixed values: validation against labels --------------------------------------------------

AGREEMENT_TARGET = 0.85
SAMPLE_SIZE = 1000
EXPANSION_SIZE = 500
MAX_EXPANSIONS = 3
CONTENT_LIMIT = 3000
UNCERTAINTY_TYPES = ["implementation", "reversal", "none"]
