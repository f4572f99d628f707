"""Secret patterns: published key formats plus one generic assignment.

Which keys are looked for follows the reference's feature list; the patterns are
our own, written from the vendors' public descriptions. Patterns use only constructs
that every common regex engine has, so a SQL check can run the same text.
"""

VENDOR_KEYS = {
    "Anthropic": r"sk-ant-[A-Za-z0-9_-]{20,}",
    "OpenAI": r"sk-(?:proj-)?[A-Za-z0-9]{20,}",
    "Stripe": r"(?:sk|rk)_live_[A-Za-z0-9]{16,}",
    "AWS": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "Supabase": r"sb(?:p|_secret)_[A-Za-z0-9_]{20,}",
}
VENDOR_KEY = "|".join(f"(?:{p})" for p in VENDOR_KEYS.values())
# Every vendor key holds a match of this; it decides on one character almost everywhere.
VENDOR_HINT = "[srA](?:k-|k_live_|b[p_]|KIA|SIA)"

JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
JWT_HINT = ".eyJ"

# The value of an assignment such as  token = "..."  or  apiKey: '...'
ASSIGNMENT = (
    r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY)"
    r"[ \t]*[:=][ \t]*[\"']([A-Za-z0-9_/+=.-]{16,})[\"']"
)
# Every match of ASSIGNMENT holds a match of this; it starts on rare characters and so scans fast.
QUOTED_VALUE = r"[:=][ \t]*[\"'][A-Za-z0-9_/+=.-]{16}"
