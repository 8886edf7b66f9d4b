"""Fixed values of the contract rules: phrases, word lists, weights, labels.

Every entry below is a value that results depend on, written in natural order.
A blank inside a phrase stands for any run of white space; everything is
matched against lower-cased text, so the phrases are lower case.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# White space that strip/split semantics rely on
# --------------------------------------------------------------------------
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = rf"[^{WS_CLASS}]+"
SPACE = rf"[{WS_CLASS}]+"

QUOTES = r"""["'\x{2018}\x{2019}\x{201c}\x{201d}]"""
NOT_QUOTES = r"""[^"'\x{2018}\x{2019}\x{201c}\x{201d}]"""


def spaced(phrase: str) -> str:
    """A phrase as a pattern: blanks match any run of white space."""
    return phrase.replace(" ", r"\s+")


#: Per alternation over phrases, a character class of what its matches begin with (our own, see ``functions.text.matches``).
INITIALS: dict[str, str] = {}


def _initials(phrase: str) -> set[str]:
    """What a phrase begins with: a letter or digit class, or the beginnings of the group it begins with."""
    if phrase.startswith("(?:"):
        group, _, rest = phrase[3:].partition(")")
        if "(" in group or rest[:1] in ("?", "*"):
            raise ValueError(f"no plain beginning: {phrase}")
        return set().union(*map(_initials, group.split("|")))
    first = phrase[:2] if phrase.startswith(r"\d") else phrase[:1]
    if not (first == r"\d" or first.isalpha()) or phrase[len(first) : len(first) + 1] in ("?", "*", "{"):
        raise ValueError(f"no plain beginning: {phrase}")
    return {first}


def any_phrase(*phrases: str) -> str:
    """Whole-word alternation over phrases."""
    pattern = r"\b(?:" + "|".join(spaced(p) for p in phrases) + r")\b"
    INITIALS[pattern] = "[" + "".join(sorted(set().union(*map(_initials, phrases)))) + "]"
    return pattern


# --------------------------------------------------------------------------
# The named clause patterns
# --------------------------------------------------------------------------
PATTERNS: dict[str, str] = {
    "negation": any_phrase(
        "shall not",
        "will not",
        "may not",
        "is not required to",
        "have no",
        "has no",
        "under no circumstances",
        "neither party shall",
        "no (?:indemnification|liability|obligation)",
        "shall not be liable",
        "not be responsible",
        "waives? all claims",
        "is under no duty",
    ),
    "reciprocal": any_phrase(
        "each party",
        "both parties",
        "mutually",
        "mutual",
        "either party",
        "reciprocal",
        "reciprocally",
        "neither party",
        "solely to the extent caused by",
        "each shall",
    ),
    "definition": (
        rf"^(?:{QUOTES}{NOT_QUOTES}+{QUOTES}\s+(?:means|shall\s+mean|refers\s+to|includes?)"
        rf"|(?:section\s+\d+|clause\s+\d+|\d+\.\d+)?\s*{QUOTES}{NOT_QUOTES}+{QUOTES}\s+(?:means|shall\s+mean)"
        r"|definitions?\s*[-\x{2014}:])"
    ),
    "recital": r"^\s*(?:whereas|now,?\s+therefore|recitals?)\b",
    "cross_reference": any_phrase(
        r"as defined in (?:section|clause|article) \d",
        r"subject to the provisions of (?:section|clause|article) \d",
        r"in accordance with (?:section|clause|article) \d",
    ),
    "boilerplate": any_phrase(
        "governing law",
        "severability",
        "entire agreement",
        "amendments? (?:must|shall) be in writing",
        "notices? shall be (?:sent|delivered)",
        "waiver of any (?:breach|provision)",
        "headings? are for (?:convenience|reference) only",
        "counterparts",
    ),
    "cap": any_phrase(
        "capped at",
        "limited to",
        "not to exceed",
        "aggregate liability",
        "maximum liability",
        "total liability shall not exceed",
        "subject to the liability cap",
        "ceiling",
        r"in no event shall.*(?:exceed|more than)",
    ),
    "payment_condition": any_phrase(
        r"upon (?:full\s+)?payment",
        r"receipt of (?:full\s+)?payment",
        "conditioned upon payment",
        "cleared funds",
        "subject to payment",
        "upon completion",
        "after acceptance",
    ),
    "cure": any_phrase(
        r"\d+\s*(?:days?|business\s+days?)\s*(?:prior\s+)?(?:written\s+)?notice",
        "opportunity to cure",
        "right to cure",
        "cure period",
        "reasonable time to (?:cure|remedy)",
        "grace period",
    ),
    "term_duration": any_phrase(
        "commences? on",
        "effective date of this agreement",
        "(?:initial term|initial period) of",
        r"shall (?:remain in effect|continue|endure) for (?:an?\s+)?(?:initial\s+)?(?:period|term)",
        "term of this agreement shall be",
        "shall expire on",
        "expiration date",
        "effective until (?:terminated|expired)",
    ),
    "termination_covenant": any_phrase(
        "(?:may|has the right to|entitled to|reserves the right to) terminate",
        "terminate (?:this agreement|the agreement|immediately|at any time|for convenience|for cause|without cause)",
        "(?:right|option) to terminate",
        "(?:notice|grounds) of termination",
        "in the event of termination",
        "upon termination",
        "following termination",
        "cancel (?:this agreement|the agreement)",
        "cancellation of this agreement",
    ),
    "renewal_covenant": any_phrase(
        r"auto(?:matically)?\s*[-]?\s*renew(?:s|al|ed|ing)?",
        r"renew(?:s|al|ed|ing)? for (?:an?\s+)?(?:additional|successive)",
        "successive (?:term|terms|period|periods)",
        "extend(?:s|ed|ing)? the term",
        r"extension of (?:the\s+)?term",
        "option to renew",
        "right to renew",
        "notice of non-renewal",
    ),
    "operative_trap": any_phrase(
        "(?:contractor|tenant|client|party|employee|licensee) (?:shall|must|hereby agrees? to) "
        "(?:indemnify|defend|hold harmless)",
        r"hereby (?:irrevocably\s+)?assigns",
        "(?:shall|will) forfeit",
        "uncapped liability",
        "immediately upon creation",
        "irrespective of whether.*(?:paid|payment)",
        r"regardless of (?:whether\s+)?(?:.*)?payment",
        "without (?:cap|limitation|limit|recourse)",
        "any and all (?:losses|claims|damages|liabilities)",
    ),
    "consequence": any_phrase(
        "reimburse(?:ment|s)?", "pay(?:s|ment|ing)?", "invoic(?:e|ing|es)?", "fees?", "expenses?", "compensation",
        "assign(?:s|ment|ing)?", "transfers?", r"grant(?:s|ing)? (?:a\s+)?license", "work made for hire",
        "indemnif(?:y|ies|ication)", "hold harmless", "defend against",
        "terminat(?:e|es|ion|ing)", "cancel(?:s|lation)?", "renew(?:s|al)?",
        "liab(?:le|ility)", "damages?", "penalt(?:y|ies)", "forfeit(?:s|ure|ing)?", "liquidated damages", "default",
        "injuncti(?:on|ve)", "specific performance", "remed(?:y|ies)", "breach",
        r"waiv(?:e|es|ed|ing) (?:any\s+)?(?:right|claim|defense|jury|trial|counterclaim|compensation)",
        "shall not", "must not", "may not", "prohibited from", "restricted from", "refrain from", "will not",
    ),
    "covenant_verb": any_phrase(
        "shall", "must", "agrees? to", "hereby agrees?", "covenants? to", "is required to", "entitled to",
        "has the right to",
    ),
    "governing_law": any_phrase(
        "governed by",
        "construed in accordance with",
        r"laws of (?:the state of\s+)?[a-z]",
        "choice of law",
        "jurisdiction of the courts?",
        "exclusive venue",
    ),
    "notices": any_phrase(
        "notices? (?:shall|must|may) be (?:in writing|given|delivered|sent|deemed given)",
        "addressed to the (?:parties|addresses|preamble)",
    ),
    "severability": any_phrase(
        "severability",
        "if any provision.*(?:invalid|illegal|unenforceable)",
        "remaining provisions shall continue",
    ),
    "counterparts": any_phrase("counterparts", "facsimile", "electronic signature", r"executed in.*counterparts"),
    "entire_agreement": any_phrase(
        "entire agreement",
        "merger clause",
        "supersedes? all prior (?:agreements|understandings|negotiations)",
    ),
    "cross_ref_body": spaced(
        r"^\s*(?:as defined in|see|refer to|capitalized terms.*meanings? (?:assigned|set forth) in) "
        r"(?:section|clause|article) [0-9ivxlcdm]+"
    ),
    "reference_mention": spaced(
        r"\b(?:section|clause|article|subsection|paragraph) ([0-9]+(?:\.[0-9]+)*|[ivxlcdm]+)\b"
    ),
    "clause_label": (
        r"^(?:section|clause|article|subsection|paragraph)?\s*([0-9]+(?:\.[0-9]+)*|[ivxlcdm]+)\b"
    ),
}

# Our own: per pattern, fragments without white space of which every match contains at least one. They begin with rare
# letters where they can ("xceed" for "exceed"), because a search compares at every place that has the first letter.
GUARDS: dict[str, list[str]] = {
    "negation": ["no", "neither", "waive"],
    "reciprocal": ["ach", "both", "mutual", "ither", "procal", "lely"],
    "cross_reference": ["fined", "visions", "cordance"],
    "cap": ["pped", "mited", "xceed", "bility", "ceiling", "vent"],
    "payment_condition": ["payment", "cleared", "pletion", "ptance"],
    "cure": ["notice", "cure", "medy", "grace"],
    "term_duration": ["commence", "ffective", "initial", "period", "term", "xpir"],
    "termination_covenant": ["minat", "cancel"],
    "renewal_covenant": ["renew", "ccessive", "xten"],
    "operative_trap": [
        "mnify", "fend", "mless", "gns", "forfeit", "capped", "creation", "pective", "gardless", "without", "losses", "claims",
        "mages", "bilities",
    ],
    "governing_law": ["verned", "construed", "laws", "choice", "jurisdiction", "xclusive"],
    "notices": ["notice", "ddressed"],
    "severability": ["verability", "provision"],
    "counterparts": ["counterparts", "facsimile", "ctronic"],
    "entire_agreement": ["ntire", "merger", "persede"],
}

# --------------------------------------------------------------------------
# Patterns used inside single rules
# --------------------------------------------------------------------------
DEFINITION_BODY = (
    rf"^\s*(?:\d+\.\d+\s+)?{QUOTES}{NOT_QUOTES}+{QUOTES}\s+(?:means|shall\s+mean|refers\s+to|includes)"
)
OPERATIVE_VERB = any_phrase(
    "shall", "must", "agrees? to", "may not", "will not", "hereby", "obligat", "waive", "forfeit", "assign",
    "indemn", "terminat", "liable",
)
_SOLE = r"\b(?:sole\s+option|unilateral\s+right|sole\s+discretion|exclusive\s+option|sole\s+right)\b"
UNILATERAL_EXTENSION = (
    rf"\b(?:client|counterparty|company|customer)\s+[^.\n]*?{_SOLE}[^.\n]*?\b(?:to\s+)?(?:extend|renew)\b"
    rf"|{_SOLE}[^.\n]*?\b(?:to\s+)?(?:extend|renew)\b"
    r"|\b(?:extend|renew)[^.\n]*?\bwithout\s+(?:requiring\s+)?(?:contractor(?:'s)?\s+)?consent\b"
)
RATE_FREEZE = spaced(r"\b(?:rates?|fees?|pricing) (?:shall remain fixed|frozen|unadjusted|cannot be increased)\b")
LONG_NOTICE = (
    r"\b(?:60|90|120|180|sixty|ninety|one\s+hundred\s+(?:and\s+)?twenty)\s*(?:\(\d+\)\s*)?"
    r"(?:days?|business\s+days?)\b"
)
CONTRACTOR_NOTICE = spaced(r"\bcontractor (?:must|shall) (?:provide|give) notice\b")
ONE_SIDED_CONVENIENCE = spaced(r"\b(?:client|company|customer) may terminate (?:for convenience|without cause)\b")
UNILATERAL_WORDING = any_phrase(
    "contractor shall", "tenant shall", "client may", "landlord may", "solely by", "sole discretion",
    "unilateral", "without contractor", "without tenant", "at client's option",
)
PROTECTIVE = any_phrase(
    "client shall (?:defend|indemnify|hold harmless) contractor",
    "contractor (?:shall not be liable|has no liability|shall have no (?:duty|obligation) to indemnify)",
    "except (?:to the extent caused by|for) (?:client|counterparty)",
    "solely to the extent (?:caused by|arising from) contractor's (?:gross negligence|willful)",
    r"(?:total|aggregate) liability (?:of contractor\s+)?shall (?:be limited|not exceed|be capped) to (?:fees|amounts)",
    "capped at (?:total fees|fees received|amounts paid)",
    r"conditioned upon (?:full\s+)?payment",
    "subject to prior written notice and (?:opportunity|right) to cure",
)
SPECIFIC_CLAUSE_QUESTION = spaced(
    r"\b(?:why is|explain|what does|how does) (?:clause|section|article|paragraph) [0-9]+"
)
GLOBAL_RISK_QUESTIONS = [
    r"\b(?:most|highest|top|worst|biggest|greatest|major|main|key|critical|primary|severe)\b.*"
    r"\b(?:risk|risks|risky|exposure|exposures|danger|dangers|trap|traps|hazard|liabilities|liability|harm|unfair"
    r"|predatory|adverse)\b",
    r"\b(?:risk|risks|risky|exposure|danger|trap|unfairness)\b.*"
    r"\b(?:rank|ranking|rankings|order|hierarchy|breakdown|summary|overview|list)\b",
    r"\b(?:rank|ranking|list)\b.*\b(?:risk|risks|risky|exposure|exposures|traps|clauses|provisions)\b",
    any_phrase(
        "materially risky", "material risks?", "high risk (?:clauses?|provisions?|terms?)",
        "worst (?:clauses?|provisions?|terms?)",
    ),
    any_phrase(
        "where am i most exposed", "what should i be most worried about", "greatest exposure", "biggest traps?",
        "top concerns?",
    ),
]

# --------------------------------------------------------------------------
# Word lists (plain containment in lower-cased text)
# --------------------------------------------------------------------------
WORDS: dict[str, list[str]] = {
    "definition_title": ["definitions", "defined terms", "interpretation"],
    "no_indemnity": ["no indemn", "shall not indemnify", "not be required to indemnify"],
    "bilateral": ["neither party shall", "neither party may terminate without cause"],
    "disclaimer": ["shall not be liable", "no liability"],
    "precedence_phrase": [
        "order of precedence", "purchase order shall control", "invoice shall control",
        "supersede and strictly control", "prevail over",
    ],
    "precedence_document": ["purchase order", "invoice", "vendor form"],
    "precedence_conflict": ["control", "prevail", "supersede", "conflict", "inconsistency"],
    "precedence_outcome": ["control", "prevail", "supersede"],
    "indemnity": ["indemn", "hold harmless", "defend and hold"],
    "uncapped": [
        "uncapped", "unlimited", "any and all", "without limitation", "all losses", "defense costs", "attorney fees",
    ],
    "ip": [
        "work made for hire", "irrevocably assign", "assigns all", "assign all", "intellectual property", "inventions",
        "deliverables", "proprietary rights", "ownership of work", "background ip",
    ],
    "ip_assignment": [
        "assigns", "transfers", "work made for hire", "irrevocably assign", "exclusive property of client",
    ],
    "ip_paid": [
        "upon full payment", "receipt of full payment", "conditioned upon payment", "cleared funds",
        "subject to payment",
    ],
    "ip_unconditional": [
        "immediately upon creation", "irrespective of whether client has paid", "regardless of payment",
        "upon inception",
    ],
    "ip_strong": ["irrevocably", "without cap", "immediate"],
    "term_forfeiture": ["forfeit", "forfeiture", "without payment", "no compensation", "relinquish all rights"],
    "term_extension_word": ["extend", "extension", "renewal", "successive"],
    "renewal_forfeiture": ["without payment for work", "forfeit", "no compensation", "relinquish all claims"],
    "renewal_notice_word": ["notice", "written notice"],
    "renewal_auto_word": ["auto", "automatic", "successive", "renew", "rollover"],
    "exit_kill": [
        "client may terminate at any time", "terminate without cause at will", "forfeit unbilled",
        "without notice or penalty", "terminate immediately at its sole option",
    ],
    "exit_forfeiture": ["without payment for work", "forfeit", "no compensation"],
    "exit_mutual": [
        "either party may terminate upon", "either party may terminate", "both parties", "non-breaching party",
        "party not in breach", "each party", "mutual written agreement", "neither party may terminate",
    ],
    "payment": [
        "payment", "invoice", "net 30", "net 60", "net 90", "net-30", "net-60", "net-90", "withhold", "setoff",
        "set off", "billing", "fees", "remit", "disbursement",
    ],
    "payment_delay": ["net 60", "net-60", "net 90", "net-90", "net 120", "within 90 days"],
    "payment_withholding": [
        "sole discretion", "arbitrarily withhold", "disputed portion", "withhold payment without interest", "setoff",
        "set off",
    ],
    "tenancy": ["enter premises", "unannounced", "routine inspection", "carpet", "deposit", "quiet enjoyment"],
    "tenancy_entry": ["unannounced", "at any hour", "without notice"],
    "tenancy_deposit": ["wear and tear", "carpet", "deposit"],
    "dispute_body": ["dispute", "governing law", "jurisdiction", "arbitration", "venue"],
    "dispute_title": ["dispute", "governing law", "jurisdiction", "arbitration"],
    "gate_consequence": [
        "indemn", "hold harmless", "defend and hold", "irrevocably assign", "work made for hire",
        "immediately upon creation", "uncapped", "without limitation or cap", "forfeit", "forfeiture",
        "waive all claims", "waives all rights", "supersede", "prevail over this agreement", "sole option",
        "unilateral right", "sole discretion to extend", "sole option to extend", "unilaterally renew",
        "unilaterally extend",
    ],
    "gate_renew": ["renew", "renewal", "extend"],
    "gate_renew_how": ["sole option", "unilateral", "sole discretion", "without contractor", "without requiring"],
    "gate_exit": ["terminate", "termination"],
    "gate_exit_how": ["immediate", "forfeiture", "without notice"],
    "gate_pay": ["invoice", "payment"],
    "gate_pay_how": ["net 90", "net-90", "withhold all", "unilateral setoff"],
    "material_trap": [
        "uncapped", "unlimited", "forfeit", "immediately", "without limitation", "at will", "sole discretion",
        "sole option", "discretionary audit", "withhold", "setoff", "non-refundable", "90 days", "without cause",
    ],
    "reference_overrides": [
        "conflict", "inconsistency", "prevail", "supersede", "override", "govern", "notwithstanding",
    ],
    "reference_limits": [
        "subject to", "except as", "unless otherwise", "conditioned upon", "capped by", "provided that",
        "in accordance with",
    ],
    "reference_expands": [
        "in addition to", "together with", "including without limitation", "as well as", "cumulative to",
    ],
    "legal_keywords": [
        "agreement", "contract", "parties", "party", "terms", "covenant", "section", "clause", "shall", "indemnif",
        "liability", "termination", "warranty", "governing law", "jurisdiction", "confidential", "breach", "recitals",
        "whereas", "in consideration", "obligations", "intellectual property", "tenant", "landlord", "contractor",
        "client", "employee", "employer", "licensor",
    ],
    "scenario_exit": ["cancel", "terminate", "stops paying", "midway"],
    "asked_for_five": ["5", "five", "top 5", "top five"],
}

# Keyword families that choose a replacement text, in order of precedence
COUNTER_FAMILIES: list[tuple[str, list[str]]] = [
    ("ip", ["intellectual property", "inventions", "work made for hire", "deliverables", "assigns all", "assign all"]),
    ("precedence", ["order of precedence", "purchase order", "invoice shall control", "override"]),
    ("indemnity", ["indemn", "hold harmless", "defense costs", "attorney fees"]),
    ("exit", ["terminat", "cancel", "forfeit"]),
    ("renewal", ["renew", "auto-renew", "extension", "lock-in"]),
    ("payment", ["payment", "invoice", "withhold", "setoff", "net 90", "net 60"]),
    ("access", ["audit", "inspection", "enter premises", "deposit"]),
]

# Display categories by upper-case fragment, first match wins
DISPLAY_CATEGORIES: list[tuple[str, list[str]]] = [
    ("TERMINATION", ["TERMINAT"]),
    ("LIABILITY", ["LIABIL", "INDEMN"]),
    ("IP_RIGHTS", ["IP", "INTELLECTUAL", "PROPERT"]),
    ("PAYMENT", ["PAY", "FEE"]),
    ("DISPUTE", ["DISPUT", "ARBITRAT"]),
]

# Contract families by file-name fragment, first match wins
CONTRACT_FAMILIES: list[tuple[str, list[str]]] = [
    ("lease", ["lease", "tenan", "apartment"]),
    ("nda", ["nda", "confidential"]),
]

# Page titles too generic to locate a clause by
GENERIC_TITLES = [
    "payment", "term", "liability", "confidentiality", "indemnification", "warranty", "general", "notices",
    "definitions", "misc",
]
RUNNING_HEADER_WORDS = ["CONFIDENTIAL", "PROPRIETARY", "PAGE "]
HEADING_NOISE_WORDS = ["CONFIDENTIAL & PROPRIETARY", "PAGE "]

# --------------------------------------------------------------------------
# Enumerations, weights and limits
# --------------------------------------------------------------------------
NON_RISK_KINDS = ["DEFINITION", "HEADING", "RECITAL", "BOILERPLATE"]
RISK_ORDINAL = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "NEUTRAL": 0}
DEFAULT_SCORE_BY_LEVEL = {"HIGH": 80, "MEDIUM": 60, "LOW": 20, "NEUTRAL": 10}
MAX_UPLOAD_BYTES = 26_214_400
UPLOAD_SUFFIXES = [".pdf", ".docx", ".txt"]
MIN_LEGAL_KEYWORDS = 3
WINDOW_WORDS = 350
BATCH_CHARS = 6000
EMBED_DIM = 384
# Fairness weights in tenths, so that sums stay exact integers
FAIRNESS_WEIGHT_TENTHS = {"NON_RISK": 2, "NEUTRAL": 5, "LOW": 10, "MEDIUM": 18, "HIGH": 30}

# --------------------------------------------------------------------------
# Segmentation patterns (case-sensitive unless noted)
# --------------------------------------------------------------------------
SECTION_HEADING = (
    r"(?:^(?:(?:Section|Clause|Article|ARTICLE|SECTION|CLAUSE)\s+[\dIVXLCDM]+[.:\s][^\n]*)"
    r"|^(?:\d{1,2}\.\s+[A-Z][^\n]*)"
    r"|^(?:[A-Z\s]{4,}(?:AGREEMENT|TERMS|INDEMNIF|TERMINATION|LIABILITY|PAYMENT|WARRANTY|CONFIDENTIAL|DISPUTE"
    r"|GOVERNING|REMEDIES)[A-Z\s]*:?))"
)
# matched without regard to case
NUMBERED_HEADING = r"^(?:(?:section|clause|article)\s+[\divxlcdm]+|\d{1,2}\.)"
RECITALS_LINE = r"^\s*(?:recitals|recitals:|whereas)\b"
NUMBERED_LINE = r"^\s*(?:(?:section|clause|article)\s+[\divxlcdm]+|\d{1,2}\.\s+[a-z])"
HEADING_PREFIX = r"^(?:(?:section|clause|article)\s*[\divxlcdm]+[:.]?\s*|\d{1,2}\.\s*)"
TITLE_PREFIX = r"^(?:(?:section|clause|article)\s*[\divxlcdm]+[:.]?\s*|\d+\.\d+\s*)"
SUBCLAUSE_START = r"^(\d{1,2}\.\d{1,3})\s+"

CITATION = r"\[CITE:([a-zA-Z0-9_-]+)\]"
