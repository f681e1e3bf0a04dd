"""Catalogues of patterns, word lists, thresholds and tables, as data.

Everything in this file is a fixed value, on which results depend, but for NEEDED, GATES and FOLDED: these are aids of our own
to search faster, and results are the same without them.
"""

from __future__ import annotations

#: Flags for patterns that must treat letters, digits, spaces and word ends as Unicode has them, with "." any character but "\n".
UNICODE = "(?Ud)"
ANY_CASE = "(?iUd)"

REDACTED = "[REDACTED]"

#: The one letter that is a K where case does not count, but that Java does not find in the range A-Z.
KELVIN = "\u212a"

#: Span detectors: name, pattern, in order of detection.
DETECTORS = [
    ("CREDIT_CARD", UNICODE + r"(?<!\d)(?:[0-9][ -]?){13,19}(?<!\s)\d(?!\d)"),
    ("SSN", ANY_CASE + r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", ANY_CASE + rf"\b[A-Z{KELVIN}0-9._%+-]+@[A-Z{KELVIN}0-9.-]+\.[A-Z{KELVIN}]{{2,}}\b"),
    ("IPV4", ANY_CASE + r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("AWS_KEY", ANY_CASE + rf"\b(?:AKIA|ASIA)[0-9A-Z{KELVIN}]{{16}}\b"),
    ("OPENAI_KEY", ANY_CASE + r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("GITHUB_KEY", ANY_CASE + r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("GOOGLE_KEY", ANY_CASE + r"\bAIza[0-9A-Za-z_-]{30,}\b"),
    ("SLACK_TOKEN", ANY_CASE + r"\bxox[baprs](?:-[A-Za-z0-9-]{10,})+"),
    ("SECRET_ASSIGN", ANY_CASE + r"\b(?:(?:api|secret|client|pass|user)_?)?(?:key|token|password|secret)\s*[:=]\s*\S+"),
]
#: What a text must hold, in lower case, for a pattern to match at all: one of these. Searching for a literal is many
#: times as fast as a pattern that ignores case, and most texts hold none. "digit" stands for any decimal digit.
NEEDED = {
    "CREDIT_CARD": ["digit"], "SSN": ["digit"], "IPV4": ["digit"], "EMAIL": ["@"], "AWS_KEY": ["akia", "asia"], "OPENAI_KEY": ["sk-"],
    "GITHUB_KEY": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "GOOGLE_KEY": ["aiza"], "SLACK_TOKEN": ["xox"], "SECRET_ASSIGN": ["key", "token", "password", "secret"],
    "TR1": ["training"], "TR2": ["trained", "memoriz"], "TR3": ["dataset", "corpus", "knowledge"], "TR4": ["your"],
    "PI1": ["card"], "PI2": ["ssn", "social"], "PI3": ["passport", "driver"], "PI4": ["pii", "personal", "financial"], "PI5": ["bank"],
    "UN1": ["redact"], "UN2": ["redact", "censor", "filter"], "UN3": ["unfiltered", "uncensored", "raw", "unredacted"],
    "JB1": ["ignore", "bypass", "override", "disregard"], "JB2": ["now"], "JB3": ["bypass"],
    "RO1": ["act", "pretend", "roleplay", "now"], "RO2": ["dan", "jailbreak", "mode"], "RO3": ["unrestricted", "new"],
    "DI1": ["prompt", "instruction"], "DI2": ["first"], "DI3": ["reveal"], "DI4": ["prompt", "instruction"],
    "RETRIEVAL": ["show", "give", "provide", "list", "extract", "reproduce", "return", "get", "tell", "examples", "instances", "access", "reveal", "dump", "print", "output"],
    "TARGET": ["training", "dataset", "corpus", "card", "ssn", "social", "passport", "email", "personal", "financial", "bank", "raw", "memorized", "prompt", "internal"],
}
#: What a match holds besides, told by a search that begins at a mark or digit and so takes far less than the pattern.
GATES = {"CREDIT_CARD": "[0-9](?:[ -]?[0-9]){12}", "SSN": UNICODE + r"-\d{2}-", "IPV4": UNICODE + r"\.\d{1,3}\.", "SECRET_ASSIGN": "[:=]"}
#: Letters that a pattern takes for ASCII ones when it ignores case, and that lower() leaves as they are.
FOLDED = ["\u017f", "\u0131"]

#: Letters by how often they begin something, the rarest first: a search for a literal stops at each place that begins as it does.
LETTERS = "zqxjkwvyfgbhpmudclornstaie"

KEY_TYPES = ["AWS_KEY", "OPENAI_KEY", "GITHUB_KEY", "GOOGLE_KEY", "SLACK_TOKEN", "SECRET_ASSIGN"]
LUHN_DIGITS = (12, 19)

#: Obfuscation.
SYMBOLS_BETWEEN_LETTERS = r"([a-zA-Z])([$#@!&*\-_+=|\\:/;~`^]+)(?=[a-zA-Z])"
#: Searches that find no less than those above and below, and take less: they begin at what is rare. Aids of our own, as NEEDED.
SYMBOLS_GATE = r"[$#@!&*\-_+=|\\:/;~`^](?<=[a-zA-Z].)[$#@!&*\-_+=|\\:/;~`^]*[a-zA-Z]"
SPACED_GATE, SPACED_PART = UNICODE + r"\s[a-zA-Z]\s+[a-zA-Z]\s", UNICODE + r"\s[a-zA-Z]\s+[a-zA-Z]"
QUOTE_MARKS, LATEX_HEAD = ["`", "'", '"'], "$\\text{"
QUOTED_GATE = UNICODE + r"([`'\"][a-zA-Z][`'\"]\s+){2,}"
QUOTED_LETTER = UNICODE + r"[`'\"]([a-zA-Z])[`'\"]\s*"
QUOTED_RUN = UNICODE + r"([`'\"][a-zA-Z][`'\"]\s*){3,}"
SPACED_LETTERS = UNICODE + r"\b[a-zA-Z](?:\s+[a-zA-Z]){4}(?:\s+[a-zA-Z]){0,3}\b"
SPACED_WORDS = ["ignore", "bypass", "override", "disregard", "forget"]
LATEX_TEXT = r"\$\\text\{([^}]+)\}\$"
LEET = ("0134578@$", "oieastbas")
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00a0"
OBFUSCATION_RISK = 15

#: Behaviour groups: category, behaviour, patterns by id; the first that matches is the one named.
BEHAVIOURS = [
    ("data_exfiltration_markers", "training_references", [
        ("TR1", r"\b(training\s+(data|set|memory|examples|records|output|logs))"),
        ("TR2", r"\b(trained\s+on|memoriz\w*)\b"),
        ("TR3", r"\b(dataset|corpus|knowledge\s+base)\b"),
        ("TR4", r"\bfrom\s+your\s+(training|data|knowledge)\b"),
    ]),
    ("data_exfiltration_markers", "pii_identifiers", [
        ("PI1", r"\b(credit\s*card|payment\s*card)\b"),
        ("PI2", r"\b(ssn|social\s*security)\b"),
        ("PI3", r"\b(passport|driver.?s?\s*licen[cs]e)\b"),
        ("PI4", r"\b(pii|personal\s*information|financial\s*identif)\b"),
        ("PI5", r"\b(bank\s+(account|details|number))\b"),
    ]),
    ("data_exfiltration_markers", "unfiltered_requests", [
        ("UN1", r"redact\s+(nothing|none|zero)\b"),
        ("UN2", r"\b(don'?t|do\s*not|never|with\s*out)\s+(redact|censor|filter)\b"),
        ("UN3", r"\b(unfiltered|uncensored|raw|unredacted)\b"),
    ]),
    ("system_manipulation", "jailbreak_attempts", [
        ("JB1", r"\b(ignore|bypass|override|disregard)\b.*\b(instructions?|rules?|prompts?|guidelines?|filters?|protocols?|limits?)\b"),
        ("JB2", r"\byou\s+(are\s+now|must\s+now)\b"),
        ("JB3", r"\bbypass\s+(all\s+)?(filters?|restrictions?)\b"),
    ]),
    ("system_manipulation", "role_manipulation", [
        ("RO1", r"\b(act\s+as|pretend|roleplay|you\s+are\s+now)\b"),
        ("RO2", r"\b(dan|jailbreak|developer\s+mode|devmode)\b"),
        ("RO3", r"\b(unrestricted|new\s+ai)\b"),
    ]),
    ("system_manipulation", "disclosure_requests", [
        ("DI1", r"\b(system\s+prompt|base\s+prompt|your\s+instructions?)\b"),
        ("DI2", r"\b(first\s+\d+\s+(tokens?|words?|characters?))\b"),
        ("DI3", r"\breveal\s+(your|the|it)\b"),
        ("DI4", r"\b(show\s+me|print|output|say|give)\s+(your|the)\s+(system\s+)?(prompt|instructions?)\b"),
    ]),
]
RETRIEVAL = ANY_CASE + r"\b(?<!in\s)(show|give|provide|list|extract|reproduce|return|get|tell\s*me|examples|instances|access|reveal|dump|print|output)\b"
TARGET = ANY_CASE + (
    r"(training\s+(data|set|memory|output|logs|examples)|dataset|corpus|credit\s*card|ssn|social\s*security|passport|email\s*(addresses|of)|"
    r"personal\s+info|financial\s+identifiers|bank\s+(details|numbers)|raw\s+(logs|conversations|text|outputs)|memorized|base\s+prompt|system\s+prompt|internal\s+tools)"
)
STRONG_TARGETS = ["credit card", "ssn", "social security", "dataset", "training data", "memorized", "passport", "email", "financial"]

#: Semantic layer.
FALLBACK_TRAINING = ["training", "learned", "memorized"]
FALLBACK_PII = ["credit card", "ssn"]
FALLBACK_CONFIDENCE = 0.6
INTENTS = {
    "action_intents": {"retrieve_data": ["show me", "give me", "provide", "display", "list"], "bypass_controls": ["ignore", "bypass", "override", "disable"]},
    "target_intents": {"training_data": ["training data", "training examples", "memorized", "dataset"], "pii_data": ["credit card", "ssn", "passport", "personal information"]},
    "modifier_intents": {"unfiltered": ["redact nothing", "unfiltered", "uncensored", "raw"]},
}
#: Rules: name, risk, and for each dimension the intents of which one must reach the least score.
RULES = [
    ("Training Data Exfiltration", 95, [("action_intents", ["retrieve_data"], 0.65), ("target_intents", ["training_data", "pii_data"], 0.60)]),
    ("Unfiltered PII Request", 90, [("target_intents", ["pii_data"], 0.60), ("modifier_intents", ["unfiltered"], 0.65)]),
]
BASELINES = [("action_intents", "bypass_controls", 0.75, 60), ("target_intents", "training_data", 0.70, 55)]

#: Injection layer.
INJECTION_WORDS = ["ignore", "bypass", "override"]
INJECTION_STEP = 0.15
INJECTION_LABEL = "INJECTION"

#: Fusion and triage.
OBFUSCATION_CONFIDENCE = 0.8
BEHAVIOUR_CONFIDENCE = 0.85
CONFIDENT = 0.8
CONFIDENT_BLOCK = 85
CONFIDENT_SAFE = 20
VERDICTS = [(80, "BLOCKED"), (60, "HIGH_RISK"), (40, "MEDIUM_RISK")]
POLICY = {"BLOCKED": "BLOCK", "HIGH_RISK": "BLOCK", "MEDIUM_RISK": "REDACT", "SAFE": "ALLOW"}
VERDICT_ALIASES = {
    "BLOCKED": ["BLOCKED", "BLOCK", "MALICIOUS", "ATTACK"],
    "SAFE": ["SAFE", "BENIGN", "OK"],
    "HIGH_RISK": ["HIGH_RISK", "HIGHRISK", "HIGH"],
    "MEDIUM_RISK": ["MEDIUM_RISK", "MEDIUMRISK", "MEDIUM", "UNCERTAIN"],
}
ATTACKS = ["BLOCKED", "HIGH_RISK"]

#: Judges: base address, default model and the variable that holds the key, by provider.
PROVIDERS = {
    "google": ("https://generativelanguage.googleapis.com/v1beta", "gemini-2.5-flash", "GEMINI_API_KEY"),
    "anthropic": ("https://api.anthropic.com/v1", "claude-3-5-haiku-latest", "ANTHROPIC_API_KEY"),
    "openai": ("https://api.openai.com/v1", "gpt-4o-mini", "OPENAI_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1", "openrouter/auto", "OPENROUTER_API_KEY"),
    "opencode-zen": ("https://opencode.ai/zen/v1", "deepseek-v4-flash-free", "OPENCODE_ZEN_API_KEY"),
}
JUDGE_SCORE = r'risk_score["\s:]+(\d+)'
JUDGE_DEFAULTS = (50, "MEDIUM_RISK", "LLM analysis")
RATE_LIMIT, RATE_SECONDS = 15, 60
#: Tokens that the injection classifier reads of a text.
CLASSIFIER_TOKENS = 512
#: Risks from which a bar is drawn as middling and as high.
BAR_GRADES = (40, 70)
