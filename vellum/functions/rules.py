"""Rules of the line scanner, as data: extend them by rows, not by code."""

# The fragments, kinds, patterns and character sets below are data that results depend on.
VERBS = r"(?:ignor\w*|disregard\w*|forget|override|overrid\w+|bypass\w*|discard\w*|skip|set\s+aside|pay\s+no\s+attention\s+to|do\s+not\s+follow|don'?t\s+follow|no\s+longer\s+follow|never\s+follow|stop\s+following)"
QUALIFIERS = r"(?:all|any|every|earlier|prior|previous|preceding|foregoing|above|original|initial|former|old|existing|your)"
OBJECTS = r"(?:instruction|instructions|guidance|guidelines?|rules?|prompts?|directions?|directives?|context|constraints?|restrictions?|guardrails?|system\s+messages?|training|programming|orders?)"
WINDOW = r"(?:[^.;:!?\n]{0,60}?)"
FOLLOWS = r"(?=[^\n]{0,80}?\b(?:you|your|please|kindly)\b|\s*(?:ignore|disregard|forget|override|bypass|include|add|insert|mark|make|set|force|ensure|keep|state|say|tell|write|output|print|reveal|generate|summaris\w+|summariz\w+|note|remember|use|approve|skip|do|don'?t|always|never|when|whenever|once|before|after|first|instead|from\s+now|what|why|how|who|where|which|can|could|should|would|does|is|are|list|explain|describe|repeat|answer)\b|\s*(?:\S+\s+){0,3}?(?:correct|answer|answers|always|every|instructions?|prompt|approve|ignore|option\s+[A-Da-d1-4])\b)"

#: (kind, whether case is ignored, pattern), in the order in which they are tried.
RULES: list[tuple[str, bool, str]] = [
    ("instruction_override", True, r"\b" + VERBS + r"\b" + WINDOW + r"\b" + QUALIFIERS + r"\s+(?:\w+\s+){0,2}?" + OBJECTS + r"\b"),
    ("instruction_override", True, r"\b" + VERBS + r"\b" + WINDOW + r"\b(?:(?:the|everything|anything|all)\s+(?:above|before|preceding|foregoing|earlier|prior)\b|what\s+you\s+(?:were|have\s+been)\s+told\b|what\s+(?:came|went)\s+before\b)"),
    ("instruction_override", True, r"\bnew\s+(?:instructions?|directive|task|rules?|prompt)\s*[:\-]"),
    ("instruction_override", True, r"\b(?:instead\s+of|rather\s+than)\s+(?:following|obeying)\s+(?:the|your|those|these|all)\b"),
    ("role_assignment", True, r"\b(?:from\s+now\s+on|starting\s+now|for\s+the\s+rest\s+of\s+this)\b[^.\n]{0,20}?\byou\s+(?:are|will\s+be|must\s+be|act)\b"),
    ("role_assignment", True, r"\byou\s+are\s+(?:now|no\s+longer|hereby|henceforth)\b"),
    ("role_assignment", False, r"\b[Yy]ou\s+are\s+(?:an?\s+|the\s+)?(?:[A-Z]{2,}[A-Za-z0-9_-]*)\b"),
    ("role_assignment", False, r"\b[Yy]ou\s+are\s+(?:an?\s+|the\s+)?[A-Z][A-Za-z0-9_-]+\s*,\s*(?:a|an|the)\b"),
    ("role_assignment", True, r"\byou\s+are\s+(?:an?|the)\s+(?:\w+\s+){0,2}?(?:ai|a\.i\.|llm|language\s+model|model|assistant|chatbot|bot|agent|system)\b"),
    ("role_assignment", True, r"\bwith(?:out)?\s+(?:no\s+|any\s+)?(?:restrictions?|limits?|limitations?|filters?|guardrails?|rules?)\b[^.\n]{0,20}?\b(?:you|model|assistant|ai)\b|\byou\s+(?:are|have)\b[^.\n]{0,30}?\b(?:no|without)\s+(?:restrictions?|limits?|limitations?|filters?|guardrails?)\b"),
    ("role_assignment", True, r"\b(?:act|behave|respond|answer|speak|reply)\s+as\s+(?:an?\s+|if\s+you\s+)"),
    ("role_assignment", True, r"\bpretend(?:\s+to\s+be|\s+that\s+you)?\b|\brole[\s-]?play\b|\byour\s+new\s+(?:role|task|job|persona|identity|instructions?)\b|\bassume\s+the\s+(?:role|persona|identity)\s+of\b"),
    ("role_assignment", True, r"\byou\s+will\s+now\s+(?:act|be|behave|respond|answer|reply|obey|follow|ignore|pretend|only|always|never|output|write|say|generate|summarise|summarize|operate|function)\b"),
    ("ai_addressed", True, r"\b(?:note|notes|message|instruction|instructions|reminder|directive|memo|aside|comment|hint|tip|attention|prompt)\s+(?:to|for)\s+(?:the\s+|any\s+|all\s+)?(?:ai|a\.i\.|artificial\s+intelligence|assistant|ai\s+assistant|model|language\s+model|llm|chatbot|bot|machine|system|summaris\w+|summariz\w+|reviewer\s+bot|automated\s+\w+|generator|claude|chatgpt|gpt|copilot|gemini)\b"),
    ("ai_addressed", True, r"\b(?:dear|hey|hello|hi|ok|okay|attention)\s+(?:ai|a\.i\.|assistant|ai\s+assistant|language\s+model|model|llm|chatbot|claude|chatgpt|gpt|copilot|gemini)\b"),
    ("ai_addressed", True, r"\b(?:ai|a\.i\.|assistant|ai\s+assistant|language\s+model|llm|chatbot|claude|chatgpt|gpt|copilot|gemini)\s*[,:]\s*(?:please\s+|kindly\s+|now\s+)?(?:ignore|disregard|note|include|add|remember|output|write|say|do|mark|state|make|set|use|read|follow|summaris\w+|summariz\w+)\b"),
    ("ai_addressed", True, r"^\s*(?:reviewer|grader|summari[sz]er|summari[sz]ing\s+agent|assistant|model|bot|ai|a\.i\.|llm|claude|chatgpt|gpt|copilot|gemini)(?:\s+bot|\s+assistant|\s+model)?\s*:\s*" + FOLLOWS),
    ("ai_addressed", True, r"\bas\s+an?\s+(?:ai|a\.i\.|llm|language\s+model|chatbot|artificial\s+intelligence)\b"),
    ("ai_addressed", True, r"\b(?:ai\s+assistant|language\s+model|llm|chatbot|ai\s+model|ai\s+system|assistant)\s+(?:that\s+|which\s+|who\s+)?(?:is\s+|are\s+)?(?:summaris\w+|summariz\w+|generat\w+|read\w*|process\w*|writ\w+|creat\w+|review\w*|train\w*)\b"),
    ("prompt_disclosure", True, r"\b(?:system|initial|hidden|original)\s+prompt\b"),
    ("prompt_disclosure", True, r"\b(?:reveal|disclose|print|output|repeat|show|expose|leak|dump|echo|recite)\b[^.\n]{0,30}?\b(?:your|the|these|its)\s+(?:system\s+|hidden\s+|initial\s+|original\s+|full\s+)?(?:prompt|prompts|instructions|guidelines|configuration|context|rules)\b"),
    ("prompt_disclosure", True, r"\b(?:do\s*n[o']?t|never|don't|without)\s+(?:tell|telling|mention|mentioning|reveal|revealing|disclose|disclosing|show|showing|informing|inform)\b[^.\n]{0,30}?\b(?:the\s+)?(?:user|reviewer|human|reader|anyone|sme|operator\s+reading)\b"),
    ("prompt_disclosure", True, r"\bkeep\s+th(?:is|ese)\s+(?:instructions?|note|text|message|secret|part|section)\b[^.\n]{0,20}?\b(?:secret|hidden|confidential|to\s+yourself|between\s+us)\b"),
    ("generation_directive", True, r"\bwhen\s+(?:you\s+)?(?:summaris\w+|summariz\w+|generat\w+|creat\w+|writ\w+|produc\w+|paraphras\w+|translat\w+|process\w+|read\w+|convert\w*|train\w*)\b[^.\n]{0,40}?\b(?:this|the|these)\s+(?:document|sop|procedure|text|training|content|instructions?|material)\b"),
    ("generation_directive", True, r"\b(?:when|while|if|before)\s+(?:you\s+(?:are\s+)?)?(?:generating|creating|writing|producing|building|drafting|making|preparing)\s+(?:the\s+|any\s+|a\s+)?(?:training|course|quiz|question|questions|assessment|summary|summaries|objectives?|module|lesson)\b"),
    ("generation_directive", True, r"""\b(?:option|answer|choice|response)\s*[\"'(\[]?[A-Da-d1-4][\"')\]]?\s*(?:\w+\s+){0,3}?\b(?:is|as|are|be)\s+(?:always\s+|the\s+)?(?:correct|right|true)\b"""),
    ("generation_directive", True, r"\b(?:mark|make|treat|select|choose|pick|set)\s+(?:option|answer|choice|response)\b"),
    ("generation_directive", True, r"""\b(?:mark|make|treat|select|choose|pick)\s+(?:option\s+|answer\s+|choice\s+)?[\"'(\[]?[a-dA-D1-4][\"')\]]?\b[^.\n]{0,25}?\b(?:correct|right|the\s+answer)\b"""),
    ("generation_directive", True, r"\b(?:correct\s+answer|answer\s+key)\b[^.\n]{0,25}?\b(?:always|every\s+question|for\s+all\s+questions)\b"),
    ("generation_directive", True, r"""\b(?:make|set|force|ensure|keep|leave|mark|choose|pick|select)\s+(?:every|all|each)\s+(?:answer|option|choice|question|response)s?\s+(?:be\s+|is\s+|are\s+|=\s*|to\s+be\s+)?[\"'(\[]?[A-Da-d1-4][\"')\]]?\b"""),
    ("generation_directive", True, r"\b(?:when|whenever|once|after|before)\s+you\s+(?:build|make|create|generate|write|produce|prepare|draft|compile)\s+(?:the|a|an|this|these|any)\s+(?:quiz|test|assessment|question|questions|training|course|module|summary|summaries|objectives?|lesson)\b"),
    ("generation_directive", False, r"\b(?:correct|right)\s+(?:option|answer|choice|response)\b[^.\n]{0,30}?\b(?:always|every|first|last|A|B|C|D)\b"),
    ("generation_directive", True, r"(?:^|[.;:!?]\s+|\band\s+|\bthen\s+|\bplease\s+|\balso\s+|,\s*)(?:state|say|claim|assert|report|write|answer)\s+that\b"),
    ("generation_directive", True, r"\btell\s+(?:the\s+)?(?:learner|learners|reader|readers|user|users|trainee|trainees|student|students|them)\b"),
    ("generation_directive", True, r"\b(?:include|add|insert|append|put|embed|mention)\b[^.\n]{0,40}?\b(?:in|into|to)\s+(?:the\s+|every\s+|each\s+|any\s+|all\s+|your\s+)?(?:objective|objectives|question|questions|summary|summaries|answer|answers|quiz|training|course|module|lesson)\b"),
    ("prompt_delimiter", False, r"<\|[^\n]{0,40}?\|?>"),
    ("prompt_delimiter", False, r"\[/?INST\]|\[/?SYS\]|<</?SYS>>"),
    ("prompt_delimiter", False, r"<\|?(?:im_start|im_end|endoftext)\|?>"),
    ("prompt_delimiter", True, r"</?\s*(?:system|assistant|user|human|instructions?|prompt|system_prompt|im_start|im_end)\s*/?>"),
    ("prompt_delimiter", True, r"^\s*(?:`{3,}|~{3,})\s*(?:system|assistant|user|human|instruction|instructions|prompt|context|developer)\b\s*$"),
    ("prompt_delimiter", True, r"^\s*#{2,}\s*(?:instruction|instructions|system|response|human|assistant|user|input|output|context|prompt)\b\s*:?\s*$"),
    ("prompt_delimiter", False, r"\b(?:BEGIN|END|START|STOP)[ _-]+(?:SYSTEM|PROMPT|INSTRUCTION|INSTRUCTIONS|CONTEXT|ASSISTANT|USER)\b"),
    ("role_marker", True, r"^\s*(?:system|assistant|user|human|ai)\s*:\s*" + FOLLOWS),
    ("html_markup", True, r"</?\s*(?:script|iframe|object|embed|svg|img|style|form|input|link|meta|body|html|base)\b"),
    ("js_uri", True, r"\bjavascript\s*:"),
    ("js_uri", True, r"\bdata\s*:\s*text/html"),
    ("event_handler", True, r"""\bon[a-z]{3,20}\s*=\s*[\"'a-z0-9]"""),
    ("url", True, r"\b(?:https?|ftp|file)://\S+"),
    ("url", True, r"\bwww\.[a-z0-9-]+\.[a-z]{2,}\b"),
    ("email", False, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
]

HIGH_KINDS = (
    "invisible_chars", "instruction_override", "role_assignment", "ai_addressed", "prompt_disclosure", "role_marker", "prompt_delimiter",
    "generation_directive", "zero_width", "bidi_override", "homoglyph", "base64_blob", "ansi_escape", "control_char",
)
LOW_KINDS = ("url", "email", "html_markup", "js_uri", "event_handler", "repetition")
NEGATION = r"(?:do\s*not|do\s+not\s+ever|don'?t|never|cannot|can'?t|must\s+not|shall\s+not|should\s+not|avoid|failure\s+to|without)\s+(?:\w+\s+){0,2}$"
NEGATION_LOOKBACK = 28
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
INVISIBLE = "\u034f\u061c\u180e\u2028\u2029\u2061\u2062\u2063\u2064\ufff9\ufffa\ufffb"
CONFUSABLES = "АВЕЗКМНОРСТУХаеорсухіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειορυν"
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b[@-Z\\-_]|\x1b"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f-\x9f]"
TAG = r"[\x{E0000}-\x{E007F}]"
SOFT_HYPHENS = r"(?:\xad[^\xad]{0,3}){2,}"
VARIATION = r"[0-9A-Za-z][\x{FE00}-\x{FE0F}]"
BASE64 = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])"
BASE64_LEAST, BASE64_PRINTABLE = 12, 0.9
REPEATS, REPEAT_CHARS = 5, 20
EXCERPT = 160
