"""Lexicon of toxic language."""

from __future__ import annotations

#: Fixed values: (word or phrase, weight) by category.
WORDS = {
    "hate_speech": [("racist", 0.9), ("bigot", 0.8), ("supremacist", 0.95), ("supremacy", 0.9), ("inferior race", 0.95), ("ethnic cleansing", 1.0), ("subhuman", 0.95), ("degenerate", 0.7)],
    "harassment": [("loser", 0.4), ("worthless", 0.6), ("pathetic", 0.5), ("ugly", 0.4), ("nobody likes you", 0.8), ("kill yourself", 1.0), ("kys", 0.95), ("neck yourself", 1.0), ("stalking", 0.7), ("doxxing", 0.85), ("doxxed", 0.85)],
    "violence": [("murder", 0.7), ("assault", 0.6), ("stab", 0.7), ("shoot", 0.6), ("bomb", 0.6), ("massacre", 0.9), ("execute", 0.5), ("slaughter", 0.8), ("behead", 0.95), ("dismember", 0.9), ("torture", 0.8)],
    "sexual": [("pornography", 0.7), ("sexually explicit", 0.8), ("nude", 0.5), ("genitalia", 0.6), ("obscene", 0.5)],
    "self_harm": [("suicide", 0.7), ("self-harm", 0.8), ("cut myself", 0.85), ("end my life", 0.9), ("want to die", 0.85), ("overdose", 0.6), ("hang myself", 0.9)],
    "profanity": [("damn", 0.2), ("hell", 0.15), ("crap", 0.15), ("shit", 0.35), ("bullshit", 0.4), ("fuck", 0.5), ("fucking", 0.5), ("asshole", 0.5), ("bastard", 0.4), ("bitch", 0.5), ("dick", 0.35), ("piss", 0.3)],
}

#: Fixed values: (pattern, weight) by category, counted after the words.
PATTERNS = {
    "hate_speech": [(r"\bgo\s+back\s+to\s+your\s+country\b", 0.9), (r"\b(?:all|every)\s+\w+\s+(?:are|is)\s+(?:trash|garbage|scum)\b", 0.85)],
    "harassment": [(r"\byou\s+(?:are|re)\s+(?:worthless|pathetic|garbage|trash)\b", 0.8), (r"\bnobody\s+(?:cares|loves|wants)\b", 0.6)],
    "violence": [(r"\bi\s*(?:'ll|will|am\s+going\s+to)\s+(?:kill|hurt|destroy)\b", 0.95), (r"\b(?:gonna|going\s+to)\s+(?:beat|hit|punch|stab|shoot)\b", 0.9)],
    "sexual": [(r"\bsexual\s+(?:act|content|material)\b", 0.7)],
    "self_harm": [(r"\b(?:how|best\s+way)\s+to\s+(?:kill|end)\s+(?:myself|my\s+life)\b", 1.0)],
    "profanity": [(r"\bf+[u\*@]+[c\*@]+[k\*@]+", 0.45), (r"\bs+h+[i\*@!]+t+", 0.3)],
}

#: Weights of the categories in the overall score.
WEIGHTS = {"hate_speech": 1.0, "harassment": 0.9, "violence": 1.0, "sexual": 0.7, "self_harm": 1.0, "profanity": 0.4}
