"""Fixed values that results depend on: word lists, patterns and constants."""

from __future__ import annotations

# Function words that text queries leave out.
QUERY_STOP_WORDS = (
    "a an and are as at be been being but by can could did do does doing done for from had has have having he her here hers him his how i if "
    "in into is it its just me my no nor not now of off on or our ours out over own please she should so some such than that the their theirs "
    "them then there these they this those through to too under until up us very was we were what when where which while who whom why will with "
    "would you your yours again any all also am about after before because both each few more most other only same still even ever get got let "
    "like one onto per via yet"
).split()

# Words that comparisons of commitments leave out.
COMMITMENT_STOP_WORDS = (
    "the a an to of for and or on in at with about that this it is be by from up out re will should need needs must get his her their our my your so then once when after"
).split()

# Days of stability by memory type; boosts by source; weights of the retrieval score; edge weights.
STABILITY = {"preference": 90.0, "decision": 60.0, "fact": 30.0, "pattern": 120.0, "solution": 45.0, "convention": 75.0}
BOOSTS = {"semantic": 1.3, "graph": 1.1, "episodic": 1.0}
RRF_K = 60
TRANSIENT_IMPORTANCE, TRANSIENT_STABILITY = 0.3, 7.0

# Phrases of status reports, which don't last.
TRANSIENT = (
    r"(?i)\b(?:is|are|was|were)\s+(?:now\s+)?(?:complete|completed|done|finished)\b",
    r"(?i)\b(?:has|have)\s+been\s+(?:completed|finished)\b",
    r"(?i)\bphase\s+[\w.-]+\b[^.!?]*\b(?:complete|completed|done|finished)\b",
    r"(?i)\badd(?:ed|ing|s)?\s+\d+\s+(?:new\s+)?tests?\b",
    r"(?i)\b\d+\+?\s+tests?\s+(?:are\s+)?(?:passing|pass|green)\b",
    r"(?i)\ball\s+(?:\d+\s+)?tests\s+(?:are\s+)?(?:passing|pass|green)\b",
    r"(?i)\bcurrently\b",
    r"(?i)\bas of\s+(?:\d{4}|today|now|this)\b",
    r"(?i)\bin progress\b",
    r"\bWIP\b",
    r"\bTODO\b",
    r"(?i)\b(?:the\s+)?current\s+(?:date|time|run|session|branch|working\s+directory)\b",
    r"(?i)\brun\s+id\b",
    r"(?i)\b(?:is|are)\s+(?:now\s+)?(?:fully\s+)?(?:operational|up and running|unblocked)\b",
    r"(?i)\b(?:is|are|remains?)\s+(?:still\s+|currently\s+)?(?:blocked|outdated|pending)\b",
    r"(?i)\bbumped\s+(?:the\s+)?(?:\S+\s+)?version\s+to\s+v?\d",
    r"(?i)\bversion\s+(?:was\s+|has\s+been\s+)?bumped\b",
    r"(?i)\b(?:is|are)\s+now\s+(?:at|on)\s+v?\d+\.\d+",
)

# Entity names that are noise.
NOISE_NAMES = ("- [ ]", "- [x]", "todo", "n/a", "none", "null", "undefined", "true", "false", "yes", "no", "ok", "error", "warning")
NOISE_PATTERN = r"^[\s\-#*`|=>~_!@$%^&()\[\]{}<>\\/.,:;'\"+=]+$"

# What a user says who promises something or asks to be reminded.
COMMITMENT_CUE = (
    r"(?i)\b(?:i(?:'ll| will| would| need to| needed to| should| ought to| have to| had to| must| owe| promised| plan to| intend to| am going to|'m going to| gotta| got to| still have to| have yet to| said i| told \w+ i)"
    r"|remind me|don'?t (?:let me )?forget|let me not forget|not forget to|make a note to|note to self|todo for me|we (?:need|have|ought) to (?:revisit|follow up|circle back|remember|get back|come back|reconsider)"
    r"|need to (?:remember|revisit|follow up|circle back|get back to)|follow[- ]up with|circle back|get back to (?:me|him|her|them|you)"
    r"|(?:will|gonna|going to|said (?:he|she|they)(?:'d| would| will)?|supposed to) (?:send|confirm|get back|follow up|let me know|call|email|reply|deliver|share|review|sign)|owes? me|waiting (?:on|for) \w+ to)\b"
)

# Kinds of failures by their messages, the first that fits.
ERROR_CLASSES = (
    ("transient", r"\b(429|500|502|503|504)\b"),
    ("provider", r"\b(401|402)\b|(?i)credit|balance|unauthorized"),
    ("permanent", r"\b(400|422)\b"),
    ("transient", r"(?i)no tool_calls or content"),
    ("transient", r"(?i)no tool_use block"),
    ("permanent", r"(?i)parse error|validation error|invalid json"),
)
