"""Words, names, phrases and patterns that results depend on.

Everything here is data. The order inside each list is part of the contract:
label sets are reported in ``CUES`` order, phrases are looked up in list order.
"""

# --- fixed values: classes and names -----------------------------------------

CUES = ["anchoring", "authority", "framing", "herding", "recency", "overconfidence"]
NONE = "none"
CUE_CLASSES = CUES + [NONE]

SENTIMENTS = ["positive", "neutral", "negative"]

BIASED_CONDITIONS = [
    "2_no_defense",
    "3_generic_defense",
    "4_cot",
    "5_targeted_detected",
    "6_targeted_gold",
    "7_rewrite_detected",
    "8_rewrite_gold",
]
CLEAN_CONDITIONS = ["1_clean_baseline", "4_cot_clean"]
ALL_CONDITIONS = sorted(BIASED_CONDITIONS + CLEAN_CONDITIONS)
COT_CONDITIONS = ["4_cot", "4_cot_clean"]

JUDGE_SCORES = ["trigger_removed", "facts_preserved", "natural_language"]
ERROR_TYPES = {
    "trigger_removed": "trigger_retained",
    "facts_preserved": "fact_damaged",
    "natural_language": "unnatural",
}

FINAL_ANSWER = "final answer:"

# Text cells that a CSV scan reads as missing (the public pandas defaults).
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: character classes -----------------------------------------

# Code points that Python's str.strip() removes, first and last of each range.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
# Characters that Python's str.isprintable() rejects.
NON_PRINTABLE = (
    r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
)

# --- fixed values: phrase diversification ------------------------------------

REPLACE_PROBABILITY = 0.7

AUTHORITY_SOURCES = [
    "Reuters", "Bloomberg", "Goldman Sachs", "JP Morgan", "Morgan Stanley", "UBS",
    "Barclays", "Moody's", "S&P", "Fitch", "Financial Times",
]
AUTHORITY_FIND_PHRASES = [
    "according to", "as reported by", "per", "as noted by",
    "tracked by", "cited by", "in figures compiled by", "in data from",
]
AUTHORITY_NEW_PHRASES = [
    "according to", "as reported by", "per data from", "cited by",
    "in figures compiled by", "as noted by", "tracked by",
]

HERDING_FINDS = [
    "as market participants adjusted exposure",
    "amid broader institutional repositioning",
    "following wider portfolio adjustments in the sector",
    "with market participants adjusting their exposure",
]
HERDING_OPTIONS = [
    "as peers repositioned",
    "amid wider portfolio shifts",
    "as institutions reallocated",
    "with funds adjusting positions",
    "amid parallel moves by investors",
    "as peers adjusted holdings",
    "with institutions shifting exposure",
    "amid sector-wide repositioning",
    "as portfolios shifted",
    "with peers rebalancing",
]

OVERCONFIDENCE_FINDS = [
    "a pattern showing no signs of changing",
    "showing no signs of changing",
    "expected to hold",
    "a pattern expected to hold",
    "a level expected to hold",
    "a level showing no signs of changing",
    "set to remain",
    "poised to continue",
]
OVERCONFIDENCE_OPTIONS = [
    "likely to persist",
    "appearing entrenched",
    "unlikely to shift",
    "showing persistence",
    "appearing stable",
    "likely to hold",
    "seeming fixed",
    "appearing set",
    "unlikely to change",
    "showing stability",
]

FRAMING_OPTIONS = {
    "a modest": ["a slim", "a limited", "a small"],
    "a mere": ["a slim", "a bare", "a small"],
    "a solid": ["a stable", "a steady", "a maintained"],
    "a still-solid": ["a stable", "a steady", "a held"],
}
