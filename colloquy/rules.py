"""Word lists, patterns and weights used as defaults by the operators.

Everything here is a fixed value: results only agree with the published rule set
if these literals are equal to it. All operators take them as arguments, so a
caller can pass other lists. Patterns avoid look-around and back-references, so
the same string works in Spark and in other SQL engines.
"""

# ---------------------------------------------------------------- cleaning
FILLERS = [
    "um", "uh", "er", "ah", "hmm", "like", "you know", "actually",
    "basically", "literally", "kind of", "sort of", "i mean",
    "you see", "right", "okay", "so", "well", "yeah", "yep",
    "sure", "alright", "ok", "huh", "wow", "oh", "ahh",
]
SMALL_TALK = [
    r"^(hi|hello|hey|good\s+morning|good\s+afternoon|good\s+evening)",
    r"^(thanks|thank\s+you|appreciate\s+it)",
    r"^(sure|okay|ok|yep|yeah|uh\s+huh)$",
    r"^(got\s+it|understood|makes\s+sense)$",
    r"^(sounds\s+good|sounds\s+great|perfect|great)$",
]
ACKNOWLEDGEMENTS = ["yeah", "yep", "ok", "okay", "sure", "right"]
NOT_A_NAME = [
    r"(?i)^from\s+", r"(?i)\s+risk$", r"(?i)^risk\s+", r"(?i)^meeting\s+", r"(?i)^topic\s+",
    r"^\d+$", r"^[a-z]", r"(?i)^and\s+", r"(?i)^the\s+", r"(?i)^discussion\s+", r"(?i)^next\s+",
]
NAME_SHAPE = r"^(\p{Lu}\S+|\p{Lu}\S+\s+\p{Lu}\S+(\s.*)?)$"
ASSIGNMENT_PHRASES = [
    "will do", "will handle", "assigned to", "responsible for",
    "takes care of", "will take", "will work on", "will review",
    "will follow up", "will send", "will check", "will update",
]
AFFIRMATIONS = [
    "yes", "yeah", "yep", "confirmed", "agreed", "correct",
    "exactly", "right", "sure", "absolutely", "definitely",
]
WHO_WILL = r"(?i)\b(I|we|you|he|she|they|John|Jane|team)\s+will\s+\w+"
DISCOURSE_MARKERS = ["so", "well", "anyway", "however", "but", "and then"]
QUESTION_WORDS = ["what", "how", "when", "where", "who", "why", "which", "whose"]
REQUEST_PHRASES = ["please", "can you", "could you"]
COMMA_AFTER = ["however", "therefore", "furthermore", "moreover"]
COMMA_BEFORE = ["and", "but", "or"]
PRONOUNS = ["he", "she", "they", "it", "his", "her", "their", "him", "them"]

# ---------------------------------------------------------------- transcript files
HEADER_LAST_FIRST = r"^([A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+)+(?:\s+\([^)]+\))?)\s+(\d{1,2}:\d{2}(?::\d{2})?)$"
HEADER_FIRST_LAST = r"^([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+\([^)]+\))?)\s+(\d{1,2}:\d{2}(?::\d{2})?)$"
SPEAKER_COLON = r"^(\w+(?:\s+\w+)?)[:\[]\s*(.+)$"
BARE_TIMESTAMP = r"^(\d{1,2}:\d{2}(?::\d{2})?)$"
SRT_ARROW = r"\d{2}:\d{2}:\d{2},\d{3}\s*-->\s*\d{2}:\d{2}:\d{2},\d{3}"
SRT_BRACKET = r"^\[([^\]]+)\]\s*(.+)$"
SRT_COLON = r"^([A-Z]\w*(?:\s+[A-Z]\w*)?):\s+(.+)$"
LINE_SPEAKER = [
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*):",
    r"^\[([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\]",
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(\d+:\d+)",
]

# ---------------------------------------------------------------- intents
INTENT_DECISION = ["decided", "agreed", "approved", "concluded", "finalized", "settled"]
INTENT_ACTION = ["will", "should", "need to", "assigned", "responsible", "handle", "complete"]
INTENT_RISK = ["risk", "concern", "issue", "problem", "blocker", "challenge", "threat"]

# ---------------------------------------------------------------- decisions
EXPLICIT_DECISION = ["decided", "decision", "agreed", "approved", "concluded", "finalized", "settled"]
IMPLICIT_DECISION = ["let's", "we will", "we're going to", "push", "move to", "change to", "focus on"]
TIMELINE_DECISION = ["deadline", "by", "before", "after", "schedule", "delay", "postpone"]
DECISION_CATEGORIES = {
    "timeline": ["date", "deadline", "schedule", "delay", "postpone", "timeline"],
    "features": ["feature", "scope", "functionality", "requirement", "cut", "add"],
    "budget": ["budget", "cost", "money", "allocation", "$", "funding"],
    "security": ["security", "audit", "compliance", "risk"],
    "communication": ["meeting", "checkpoint", "report", "update", "standup"],
    "resources": ["team", "assign", "resource", "staff", "hire"],
    "process": ["process", "workflow", "procedure", "methodology"],
}
MONTH_DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,?\s+\d{4})?\b"
SLASH_DATE = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
WHOLE_NUMBER = r"\b\d+\b"
FROM_TO = r"(?i)from (.+?) to ([^,.\n]+)"
PATTERN_DECISION = [
    "decided", "decision", "agreed", "approved", "concluded",
    "finalized", "settled", "voted", "unanimously", "let's make",
    "we will", "we're going with", "push the", "change the", "move to",
]
CONTINUATION_WORDS = ["to", "will", "with", "for"]
CORE_DECISION = [
    r"(?i)(?:decided|agreed|approved|concluded|finalized|settled)\s+(?:to|that|on)\s+([^.!?]+)",
    r"(?i)(?:we|the team|everyone)\s+(?:will|are going to)\s+([^.!?]+)",
    r"(?i)(?:let's|we're)\s+(?:make|go with|push|change|move)\s+([^.!?]+)",
    r"(?i)(?:push|change|move)\s+(?:the|our)\s+([^.!?]+)\s+(?:to|from)",
]
RATIONALE = [r"(?i)(?:because|since|due to|given that|to provide|to ensure|to give)\s+([^.!?]+)"]
RATIONALE_LEGACY = [
    r"(?i)because\s+(.+?)(?:\.|$)",
    r"(?i)since\s+(.+?)(?:\.|$)",
    r"(?i)due to\s+(.+?)(?:\.|$)",
    r"(?i)given\s+that\s+(.+?)(?:\.|$)",
    r"(?i)to\s+(?:provide|ensure|allow|give)\s+(.+?)(?:\.|$)",
]
GROUP_WORDS = r"\b(we|team|everyone|unanimously|all)\b"
GROUP_WORDS_LEGACY = r"\b(we|team|the group|everyone|unanimously)\b"
BASIC_DECISION = [
    "decided", "decision", "agreed", "approved", "concluded",
    "resolved", "settled", "chosen", "voted", "agreement",
]
TOPUP_DECISION = [
    "decided", "decision", "agreed", "approved", "concluded",
    "finalized", "settled", "voted", "unanimously", "let's make a decision",
]
LEGACY_CONTINUATION = ["decided", "agreed", "approved", "concluded", "finalized"]
LEGACY_DECISION_TITLE = [
    r"(?i)(?:decision|decided|agreed)\s+(?:on|to|that)\s+(?:the\s+)?([A-Z][^.]{5,50}?)(?:\.|$)",
    r"(?i)([A-Z][^.]{5,50}?):\s+(?:we|the team|everyone)\s+(?:decided|agreed|approved)",
]
LEGACY_EXPLICIT_DECISION = ["decided", "agreed", "approved", "finalized", "settled", "concluded", "unanimously"]

# ---------------------------------------------------------------- actions
# (pattern, group holding the owner or 0 for the speaker, group holding the action)
ACTION_PATTERNS = [
    (r"(?i)([A-Za-z]+),?\s+(?:can you|could you|please|will you)\s+([^.!?]+)", 1, 2),
    (r"(?i)([A-Za-z]+)\s+(?:will|is going to|needs to|should|must)\s+([^.!?]+)", 1, 2),
    (r"(?i)(?:I'll|I will|I'm going to)\s+([^.!?]+)", 0, 1),
    (r"(?i)(?:let's have|ask|get)\s+([A-Za-z]+)\s+(?:to\s+)?([^.!?]+)", 1, 2),
    (r"(?i)([A-Za-z]+)\s*[-–]\s*([^.!?]+)", 1, 2),
    (r"(?i)assigned to\s+([A-Za-z]+):\s*([^.!?]+)", 1, 2),
]
# (pattern, fixed answer or None to return the first group)
DUE_DATE = [
    (r"(?i)by\s+(end of day|EOD)\s+tomorrow", "end of day tomorrow"),
    (r"(?i)by\s+([A-Za-z]+day)", None),
    (r"(?i)by\s+(next week|this week|tomorrow|today)", None),
    (r"(?i)by\s+([A-Za-z]+\s+\d{1,2}(?:st|nd|rd|th)?)", None),
    (r"(?i)(?:within|in)\s+(\d+\s+(?:days?|weeks?))", None),
    (r"(?i)(?:deadline|due):\s*([^.!?,]+)", None),
]
# (pattern, group)
DUE_DATE_LEGACY = [
    (r"(?i)by\s+(?:end\s+of\s+)?(\w+\s+\d{1,2}(?:st|nd|rd|th)?(?:\s+\w+)?)", 1),
    (r"(?i)by\s+(?:end\s+of\s+)?(\w+day)", 1),
    (r"(?i)by\s+(?:end\s+of\s+)?(\w+)", 1),
    (r"(?i)due\s+(?:by\s+)?(.+?)(?:\.|$)", 1),
    (r"(?i)(\w+day)", 1),
    (r"(?i)next\s+(\w+day)", 1),
    (r"(?i)next\s+week", 0),
    (r"(?i)end\s+of\s+(\w+)", 1),
    (r"(?i)(\d{1,2}/\d{1,2})", 1),
    (r"(?i)(\w+\s+\d{1,2})", 1),
    (r"(?i)this\s+(\w+)", 1),
    (r"(?i)today", 0),
]
DUE_DATE_BASIC = [
    (r"(?i)by\s+(\w+\s+\d{1,2}(?:st|nd|rd|th)?(?:\s+\w+)?)", 1),
    (r"(?i)due\s+(.+?)(?:\.|$)", 1),
    (r"(?i)(\w+day)", 1),
    (r"(?i)next\s+week", 0),
    (r"(?i)end\s+of\s+(\w+)", 1),
]
HIGH_PRIORITY = [
    "urgent", "critical", "asap", "immediately", "priority",
    "important", "blocker", "blocking", "must",
]
LOW_PRIORITY = ["when possible", "nice to have", "optional", "low priority"]
HIGH_PRIORITY_BASIC = ["urgent", "critical", "important", "asap", "immediately", "priority"]
LOW_PRIORITY_BASIC = ["low priority", "when possible", "nice to have"]
HIGH_PRIORITY_LEGACY = ["urgent", "critical", "important", "asap", "immediately", "priority"]
LOW_PRIORITY_LEGACY = ["low priority", "when possible", "nice to have", "eventually"]
TITLES = r"(?i)^(Dr\.|Mr\.|Ms\.|Mrs\.)\s*"
FIRST_PERSON = ["i", "i'll", "i'm"]
PLACEHOLDER_OWNERS = ["current speaker", "[current speaker]", "speaker"]
ACTION_VERBS = [
    "will", "should", "need to", "must", "going to", "plan to",
    "assigned", "responsible", "handle", "complete", "review", "follow up",
]
BASIC_PERSON_WILL = r"(?i)(\w+(?:\s+\w+)?)\s+will\s+(.+?)(?:\.|$)"
BASIC_ASSIGNED = r"(?i)assigned\s+to\s+(\w+(?:\s+\w+)?)"
BASIC_ASSIGNED_ACTION = r"(?i)to\s+(.+?)(?:\.|$)"
BASIC_GROUP_WILL = r"(?i)(?:we|team|I|the\s+team)\s+will\s+(.+?)(?:\.|$)"
BASIC_PERSON_SHOULD = r"(?i)(\w+(?:\s+\w+)?)\s+(?:should|needs? to|must)\s+(.+?)(?:\.|$)"
TOPUP_ACTION = [
    "will", "can you", "i will", "assigned", "responsible",
    "handle", "take care of", "follow up", "i'll", "we need to",
]
COMPOUND_VERBS = ["update", "coordinate", "contact", "send", "finalize", "schedule", "escalate", "get", "create"]
TRAILING_FILLER = r"(?i)\s+(?:so|okay|alright|well|now|then|also|and)$"
LEGACY_EXPLICIT_ACTION = [
    "will", "assigned", "responsible", "handle", "complete", "review", "take action",
    "follow up", "i'll", "need to",
]
LEGACY_UNASSIGNED = r"(?i)\b(?:assigned|responsible|owner|handle|take care|can you|I need you)\b"
OWNER_SENTENCE_START = r"(?i)^(\w+(?:\s+\w+)?)[,\s]+(?:will|can|should|needs? to)\s+"
OWNER_ASSIGNED = r"(?i)(?:assigned\s+to|owner is)\s+(\w+(?:\s+\w+)?)"
OWNER_RESPONSIBLE = r"(?i)(\w+(?:\s+\w+)?)\s+(?:is|are)\s+responsible"
OWNER_CAN_YOU = r"(?i)(\w+(?:\s+\w+)?)[,\s]+(?:can you|I need you to|I want you to|I'd like you to)"
OWNER_WANT_YOU = r"(?i)^(\w+(?:\s+\w+)?)[,\s]+(?:I want you to|I need you to|I'd like you to)"
OWNER_FIRST_PERSON = r"(?i)\bI\b\s+(?:will|can|should|need to|have to|must)"
OWNER_EARLIER = r"(?:assign|give|give this to|handle|take care of|responsible)"
OWNER_QUICK_FIRST_PERSON = r"(?i)\bI\b\s+(?:need|will|have)"
OWNER_QUICK_NAME = r"^([A-Z][a-z]+\s+[A-Z][a-z]+)"
PERSON_AFTER = r"\s+(?:will|can|should|needs? to)"
PERSON_BEFORE = r"(?:assigned to|responsible for|owner is)\s+"
ASK_PHRASE = r"(?:can you|I'd like you to|I want you to|I need you to)\s+(.+?)(?:\.|$)"
DUTY_PHRASE = r"(?:will|need to|should|must)\s+(.+?)(?:\.|$)"
SELF_DUTY = r"(?i)\bI\b\s+(?:need to|will|have to|must)\s+(.+?)(?:\.|$)"
PURPOSE_PHRASE = r"(?i)(?:can you|I'd like you to|I want you to|I need you to)\s+.+?\s+(?:for|to)\s+([^.]{10,80}?)(?:\.|$)"
CONTACT_WORDS = ["account manager", "contact", "email"]
TWO_NAMES = r"([A-Z][a-z]+\s+[A-Z][a-z]+)"
TIME_PHRASE = r"(?i)(?:by|due|deadline)\s+(?:end\s+of\s+)?(?:day\s+)?(\w+(?:\s+\w+)?)"
ACTION_OWNER_CANDIDATES = [
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+will\s+",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+to\s+(?:handle|complete|do|work on)",
    r"(?i)assign(?:ed)?\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:is\s+)?responsible\s+for",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+should\s+",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+can\s+(?:you\s+)?(?:please\s+)?",
]

# ---------------------------------------------------------------- risks
RISK_WORDS = [
    "risk", "concern", "worried", "issue", "problem", "blocker", "blocking",
    "challenge", "threat", "delay", "might not", "could fail", "won't have",
    "if we don't", "if we can't", "dependency", "constraint", "bottleneck",
    "vulnerability", "exposure", "gap", "shortfall", "deficit",
]
# (pattern, number of groups to join with a space)
RISK_DESCRIPTION = [
    (r"(?i)(?:risk|concern|worried)\s+(?:is\s+)?(?:that\s+)?([^.!?]+)", 1),
    (r"(?i)(?:issue|problem|blocker)\s+(?:is\s+)?(?:with\s+)?([^.!?]+)", 1),
    (r"(?i)if\s+(?:we\s+)?(?:don't|can't)\s+([^,]+),\s*([^.!?]+)", 2),
    (r"(?i)(?:might|could)\s+(?:not\s+)?([^.!?]+)", 1),
    (r"(?i)(?:delay|constraint|bottleneck)\s+(?:in|with|on)\s+([^.!?]+)", 1),
]
RISK_FALLBACK_WORDS = ["risk", "concern", "blocker", "issue"]
RISK_CATEGORIES = {
    "Timeline": ["delay", "deadline", "schedule", "timeline", "launch", "date", "week", "month"],
    "Technical": ["integration", "performance", "bug", "system", "api", "technical", "data", "security"],
    "Resource": ["budget", "staff", "person", "capacity", "resource", "team", "engineer", "support"],
    "Regulatory": ["compliance", "legal", "audit", "regulation", "gdpr", "ccpa", "privacy"],
    "Business": ["customer", "market", "competitor", "stakeholder", "revenue", "adoption"],
}
RISK_CATEGORIES_LEGACY = {
    "Timeline": ["delay", "late", "deadline", "schedule", "timeline", "on time"],
    "Resource": ["resource", "budget", "staff", "people", "capacity", "manpower"],
    "Data": ["data", "quality", "accuracy", "integrity", "missing", "corrupt"],
    "Process": ["process", "workflow", "procedure", "method", "approach"],
    "Technical": ["technical", "system", "integration", "bug", "error", "failure"],
}
BASIC_RISK = [
    "risk", "concern", "issue", "problem", "blocker", "blocking",
    "challenge", "threat", "warning", "caution", "danger", "worry",
]
TOPUP_RISK = [
    "risk", "concern", "issue", "problem", "blocker", "challenge",
    "worry", "threat", "danger", "i'm worried", "i'm concerned",
]
LEGACY_EXPLICIT_RISK = [
    "risk", "blocker", "problem", "issue", "challenge", "concern", "worry",
    "threat", "danger", "biggest risk", "critical risk",
]
RISK_TITLE = [
    r"(?i)(?:the|a|an)\s+([A-Z][^.]{5,50}?)\s+(?:risk|issue|problem|concern|challenge|blocker)",
    r"(?i)([A-Z][^.]{5,50}?)\s+(?:delay|failure|issues?|problems?|concerns?)",
    r"(?i)biggest\s+risk\s+(?:I see|is|we have)\s+(?:is\s+)?(?:the\s+)?([^.]{5,50}?)(?:\.|$)",
    r"(?i)([A-Z][^.]{5,50}?)\s+(?:not resolved|delay or failure|dependency)",
]
RISK_TITLE_WORDS = [
    "integration", "audit", "compliance", "performance", "security",
    "support", "budget", "feature", "capacity", "infrastructure",
]
RISK_LEADING_FILLER = r"(?i)^(?:so|okay|alright|well|now|then|also|and|i think|i'm|we're|there's)\s+"
RISK_CONTEXT_DESCRIPTION = [
    r"(?i)(?:risk|issue|problem|concern|challenge)\s+(?:is|that|of)\s+(.+?)(?:\.|$)",
    r"(?i)if\s+(.+?)(?:\.|$)",
    r"(?i)(.+?)\s+could\s+(?:result|lead|cause|affect)",
]
RISK_HIGH = ["critical", "high priority", "urgent", "catastrophic", "severe", "major", "blocking", "blocker"]
RISK_MEDIUM = ["medium", "moderate", "significant", "important"]
RISK_LOW = ["low", "minor", "small", "minor issue"]
RISK_IMPACT = [
    r"(?i)impact[:\s]+(.+?)(?:\.|$)",
    r"(?i)could\s+(?:result in|lead to|cause|affect)\s+(.+?)(?:\.|$)",
    r"(?i)would\s+(?:result in|lead to|cause|affect)\s+(.+?)(?:\.|$)",
    r"(?i)may\s+(?:result in|lead to|cause|affect)\s+(.+?)(?:\.|$)",
    r"(?i)if\s+(?:this|that|we)\s+(?:happens|occurs|fails)\s*[,\s]+(.+?)(?:\.|$)",
]
MITIGATION_FOR = r"(?i)for\s+[^:]+:\s+(.+?)(?:\.|$)"
MITIGATION_BULLET = r"(?im)(?:^|\n)\s*[-•*]\s+(.+?)(?:\n|$)"
MITIGATION_WE = r"(?i)we\s+(?:are|will|can|should|need to)\s+(.+?)(?:\.|$)"
MITIGATION_WE_NEXT = r"(?i)we\s+(?:are|will|can)\s+(.+?)(?:\.|$)"
MITIGATION_GATE = ["mitigation", "plan", "doing", "will", "can", "for", "we're", "we are"]
RISK_OWNER = [
    (r"(?i)(?:owner|responsible|assigned to|handle|take care of)\s+(?:is|are)\s+(\w+(?:\s+\w+)?)", 1),
    (r"(?i)(\w+(?:\s+\w+)?)\s+(?:is|will be|are)\s+(?:owner|responsible|handling)", 1),
    (r"(?i)(\w+(?:\s+\w+)?)\s+and\s+(\w+(?:\s+\w+)?)\s+(?:are|will be)\s+(?:owners|responsible)", 2),
]
RISK_OWNER_LIST = r"(?i)(?:owner|responsible)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?:\s+and\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)?)"

# ---------------------------------------------------------------- confidence
BOOST_DATES = [
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?",
    r"(?i)\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?i)\b(?:next|this|last)\s+(?:week|month|quarter)",
    r"(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)",
    r"(?i)\bQ[1-4]\b",
]
BOOST_COUNTS = [
    r"(?i)\b\d+\s*(?:features?|items?|risks?|decisions?|actions?)\b",
    r"(?i)\b\d+%\b",
    r"(?i)\$\d+(?:K|M|B)?",
    r"(?i)\b\d+\s*(?:days?|weeks?|months?|hours?)",
    r"(?i)\b(?:first|second|third|fourth|fifth|\d+)\s+(?:phase|stage|step)",
    r"(?i)\b\d+\s*(?:core|additional|total)",
]
BOOST_COMPARISONS = [
    r"(?i)(?:from|change|push|move|shift)\s+.+\s+to\s+",
    r"(?i)(?:instead of|rather than|versus|vs\.?)\s+",
    r"(?i)(?:increase|decrease|reduce|expand)\s+(?:from|by|to)\s*\d+",
]
CERTAIN_WORDS = ["will", "decided", "agreed", "must", "approved", "finalized"]
TENTATIVE_WORDS = ["should", "might", "could", "consider", "propose"]

# ---------------------------------------------------------------- validation
CONTRADICTIONS = [
    (r"\byes\b.*\bno\b", r"\bno\b.*\byes\b"),
    (r"\bwill\b.*\bwon't\b", r"\bwon't\b.*\bwill\b"),
    (r"\bcan\b.*\bcan't\b", r"\bcan't\b.*\bcan\b"),
    (r"\bagree\b.*\bdisagree\b", r"\bdisagree\b.*\bagree\b"),
]
CLEAR_ACTION_VERBS = [
    "send", "create", "update", "review", "complete", "finish",
    "schedule", "organize", "prepare", "develop", "implement",
    "follow", "contact", "coordinate", "analyze", "test",
]
DECISION_WORDS = [
    "decided", "decision", "agreed", "approved", "chosen",
    "concluded", "determined", "resolved", "settled", "finalized",
]
HAS_OWNER = [r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", r"(?i)\b(I|we|he|she|they)\b"]
STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
DATE_FORMATS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b(next|this|last)\s+(week|month|quarter)\b",
]
RISK_DOMAIN = ["Timeline", "Technical", "Resource", "Regulatory", "Business", "Other"]
PRIORITY_DOMAIN = ["high", "medium", "low"]

# ---------------------------------------------------------------- evaluation
EVAL_SCHEMA = [
    ("summary", "coverage", 0.4), ("summary", "factuality", 0.4), ("summary", "clarity", 0.2),
    ("decisions", "specificity", 0.35), ("decisions", "completeness", 0.35), ("decisions", "clarity", 0.3),
    ("action_items", "owner", 0.25), ("action_items", "timeline", 0.25),
    ("action_items", "clarity", 0.25), ("action_items", "priority", 0.25),
    ("risks", "impact", 0.35), ("risks", "likelihood", 0.3), ("risks", "specificity", 0.35),
]
SCORE_LEVELS = [
    (0.0, 3.0, "Poor"), (3.0, 5.0, "Below Average"), (5.0, 7.0, "Average"),
    (7.0, 9.0, "Good"), (9.0, 10.01, "Excellent"),
]
PASS_SCORE, WARNING_SCORE, FAIL_SCORE = 6.0, 5.0, 4.0
SOURCE_WEIGHTS = {"llm": 0.5, "human": 0.3, "metrics": 0.2}
SOURCE_WEIGHTS_WITH_HUMAN = {"llm": 0.4, "human": 0.4, "metrics": 0.2}
RECOMMENDATIONS = [
    ("summary", "coverage", "Ensure summary captures all key discussion points"),
    ("summary", "factuality", "Verify summary accuracy against transcript"),
    ("summary", "clarity", "Simplify language and improve structure"),
    ("decisions", "specificity", "Make decisions more concrete and actionable"),
    ("decisions", "completeness", "Capture all decisions made in the meeting"),
    ("action_items", "owner", "Assign clear ownership to each action item"),
    ("action_items", "timeline", "Add specific deadlines to action items"),
    ("risks", "impact", "Describe potential impact of each risk clearly"),
    ("risks", "likelihood", "Assess likelihood/probability of risks"),
]
TARGET_DECISIONS, TARGET_ACTIONS, TARGET_RISKS = 9, 20, 18

# ---------------------------------------------------------------- mentions
# (context, kind, pattern, group) — confidence is set by kind and by whether a date was resolved
TEMPORAL_MENTIONS = [
    ("explicit_date", "date", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("explicit_date", "date", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"),
    ("explicit_date", "date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("day_of_week", "date", r"\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b"),
    ("day_of_week", "date", r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b"),
    ("time_expressions", "date", r"\b\d{1,2}:\d{2}(?:\s*(?:AM|PM|am|pm))?\b"),
    ("time_expressions", "date", r"\b(?:morning|afternoon|evening|noon)\b"),
    ("time_expressions", "date", r"\bby\s+\d{1,2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b"),
    ("relative", "relative_date", r"\btomorrow\b"),
    ("relative", "relative_date", r"\btoday\b"),
    ("relative", "relative_date", r"\byesterday\b"),
    ("relative", "relative_date", r"\bnext\s+(?:week|month|quarter|year)\b"),
    ("relative", "relative_date", r"\blast\s+(?:week|month|quarter|year)\b"),
    ("relative", "relative_date", r"\bthis\s+(?:week|month|quarter|year)\b"),
    ("relative", "relative_date", r"\bin\s+\d+\s+(?:days?|weeks?|months?|years?)\b"),
    ("relative", "relative_date", r"\bwithin\s+\d+\s+(?:days?|weeks?|months?)\b"),
    ("deadline", "deadline", r"\bdue\s+(?:by\s+)?([^,.]+)\b"),
    ("deadline", "deadline", r"\bdeadline\s+(?:is\s+)?([^,.]+)\b"),
    ("deadline", "deadline", r"\bby\s+(?:the\s+)?end\s+of\s+([^,.]+)\b"),
    ("deadline", "deadline", r"\bmust\s+be\s+(?:completed|done|finished)\s+by\s+([^,.]+)\b"),
    ("deadline", "deadline", r"\bEOD\b|\bCOB\b"),
    ("deadline", "deadline", r"\bASAP\b"),
    ("deadline", "deadline", r"\bby\s+([A-Z][a-z]+day)\b"),
    ("deadline", "deadline", r"\bbefore\s+([^,.]+)\b"),
    ("duration", "duration", r"\b\d+\s*(?:minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\b"),
    ("duration", "duration", r"\b(?:a|an|one)\s+(?:minute|hour|day|week|month|year)\b"),
    ("duration", "duration", r"\b(?:several|few|couple\s+of)\s+(?:minutes|hours|days|weeks|months)\b"),
    ("frequency", "frequency", r"\b(?:daily|weekly|monthly|quarterly|annually|yearly)\b"),
    ("frequency", "frequency", r"\bevery\s+(?:day|week|month|quarter|year)\b"),
    ("frequency", "frequency", r"\bevery\s+(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b"),
    ("frequency", "frequency", r"\bonce\s+(?:a|per)\s+(?:day|week|month|quarter|year)\b"),
    ("frequency", "frequency", r"\btwice\s+(?:a|per)\s+(?:day|week|month|year)\b"),
]
# (label, pattern, ignore case, group, confidence)
ENTITY_MENTIONS = [
    ("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", False, 0, 0.8),
    ("PERSON", r"\b[A-Z]\. [A-Z][a-z]+\b", False, 0, 0.8),
    ("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?[A-Z][a-z]+\b", False, 0, 0.8),
    ("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", True, 0, 0.8),
    ("DATE", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", True, 0, 0.8),
    ("DATE", r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)day\b", True, 0, 0.8),
    ("DATE", r"\btomorrow\b|\btoday\b|\byesterday\b", True, 0, 0.8),
    ("DATE", r"\bnext\s+(?:week|month|quarter)\b", True, 0, 0.8),
    ("DATE", r"\bby\s+(?:Monday|Tuesday|Wednesday|Thursday|Friday)\b", True, 0, 0.8),
    ("TIME", r"\b\d{1,2}:\d{2}(?:\s*(?:AM|PM|am|pm))?\b", True, 0, 0.8),
    ("TIME", r"\b(?:morning|afternoon|evening|noon)\b", True, 0, 0.8),
    ("TIME", r"\bby\s+\d{1,2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b", True, 0, 0.8),
    ("DEADLINE", r"\bdue\s+(?:by\s+)?\w+\b", True, 0, 0.8),
    ("DEADLINE", r"\bdeadline\s+(?:is\s+)?\w+\b", True, 0, 0.8),
    ("DEADLINE", r"\bby\s+(?:the\s+)?end\s+of\s+\w+\b", True, 0, 0.8),
    ("DEADLINE", r"\bEOD\b|\bCOB\b", True, 0, 0.8),
    ("MONEY", r"\$[\d,]+(?:\.\d{2})?\s*(?:million|billion|thousand|k|M|B)?\b", True, 0, 0.8),
    ("MONEY", r"\b\d+(?:\.\d+)?\s*(?:million|billion|thousand)\s*dollars?\b", True, 0, 0.8),
    ("MONEY", r"\bbudget\s+of\s+\$?[\d,]+\b", True, 0, 0.8),
    ("PROJECT", r"\bProject\s+[A-Z][a-zA-Z0-9\s]+\b", False, 0, 0.8),
    ("PROJECT", r"\b[A-Z][a-zA-Z0-9]+\s+(?:project|initiative|campaign)\b", False, 0, 0.8),
    ("COMPANY", r"\b[A-Z][a-zA-Z0-9]+\s+(?:Inc|Corp|LLC|Ltd|Co)\b", False, 0, 0.8),
    ("COMPANY", r"\b(?:Google|Microsoft|Apple|Amazon|Facebook|Meta|Netflix|Tesla|IBM|Intel)\b", False, 0, 0.8),
    ("PERSON_WITH_ROLE", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),?\s+(?:our\s+)?(?:CEO|CTO|VP|director|manager|lead)\b", False, 1, 0.9),
    ("PERSON_WITH_ROLE", r"\b(?:CEO|CTO|VP|director|manager|lead)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", False, 1, 0.9),
]
ACTION_DEADLINES = [
    r"(?i)([^.]+?)\s+(?:by|due|before)\s+([^.]+)",
    r"(?i)([^.]+?)\s+deadline\s+(?:is\s+)?([^.]+)",
    r"(?i)([^.]+?)\s+must\s+be\s+(?:completed|done|finished)\s+by\s+([^.]+)",
]
