"""Domain vocabularies: terms, stop words, running headers and actors, and how a domain is told from a text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions.text import B, BEGIN, END, WS

# Common words that are never terms.
STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "arent", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "cant", "cannot", "could", "couldnt", "did", "didnt", "do", "does", "doesnt",
    "doing", "dont", "down", "during", "each", "few", "for", "from", "further", "had", "hadnt", "has", "hasnt", "have", "havent", "having", "he",
    "hed", "hell", "hes", "her", "here", "heres", "hers", "herself", "him", "himself", "his", "how", "hows", "i", "id", "ill", "im", "ive", "if",
    "in", "into", "is", "isnt", "it", "its", "itself", "lets", "ll", "me", "more", "most", "mustnt", "my", "myself", "no", "nor", "not", "of", "off",
    "on", "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "re", "same", "shant", "she", "shed", "shell",
    "shes", "shouldnt", "so", "some", "such", "than", "that", "thats", "the", "their", "theirs", "them", "themselves", "then", "there", "theres",
    "these", "they", "theyd", "theyll", "theyre", "theyve", "this", "those", "through", "to", "too", "under", "until", "up", "ve", "very", "was",
    "wasnt", "we", "wed", "well", "were", "weve", "werent", "what", "whats", "when", "whens", "where", "wheres", "which", "while", "who", "whos",
    "whom", "why", "whys", "with", "wont", "would", "wouldnt", "you", "youd", "youll", "youre", "youve", "your", "yours", "yourself", "yourselves",
    "will", "shall", "should", "may", "must", "can", "could", "would", "shouldnt", "mustnt", "shallnt", "definition", "definitions", "annex",
    "clause", "section", "paragraph", "table", "figure", "document", "documents", "standard", "standards",
]

# Curated terms of each domain. Most match with an optional s; the others have their own pattern.
TERMS = {
    "generic": [
        "conformance", "compliance", "requirement", "specification", "verification", "validation", "system", "process", "interface", "parameter",
        "performance", "implementation", "compatibility",
    ],
    "smartGrid": [
        "timeout", "heartbeat", "payload", "register", "interface", "device", "service", "agreement", "protocol", "client", "server", "security",
        "der", "voltage", "frequency", "power", "load", "storage", "generation", "inverter", "connection", "capacity", "mtls", "gateway",
        "telemetry",
    ],
    "security": [
        "security", "authentication", "authorization", "encryption", "cryptography", "tls", "certificate", "credentials", "access", "policy",
        "vulnerability", "audit", "token", "handshake", "session", "integrity", "confidentiality",
    ],
}
# The patterns of those terms that do not just take an s.
OWN_PATTERNS = {
    ("generic", "process"): r"\bprocesses?\b", ("generic", "compatibility"): r"\bcompatibilities|compatibility\b",
    ("smartGrid", "security"): r"\bsecurity\b", ("smartGrid", "frequency"): r"\bfrequenc(?:y|ies)\b", ("smartGrid", "capacity"): r"\bcapacities|capacity\b",
    ("smartGrid", "mtls"): r"\bmtls\b", ("smartGrid", "telemetry"): r"\btelemetr(?:y|ies)\b",
    ("security", "security"): r"\bsecurit(?:y|ies)\b", ("security", "cryptography"): r"\bcryptograph(?:y|ies)\b", ("security", "tls"): r"\btls\b",
    ("security", "credentials"): r"\bcredentials?\b", ("security", "access"): r"\baccess\b", ("security", "policy"): r"\bpolic(?:y|ies)\b",
    ("security", "vulnerability"): r"\bvulnerabilit(?:y|ies)\b", ("security", "integrity"): r"\bintegrity\b", ("security", "confidentiality"): r"\bconfidentiality\b",
}
# Stop words, running headers and actors of each domain.
MORE_STOPWORDS = {"generic": [], "smartGrid": ["ieee"], "security": ["security", "standard", "iso", "rfc"]}
HEADERS = {"generic": ["standard", "section", "page"], "smartGrid": ["energy services interface", "ieee std", "prepared by"], "security": ["security", "confidential", "proprietary", "iso", "rfc"]}
ACTORS = {
    "generic": ["client", "server", "device", "system", "user", "application"],
    "smartGrid": ["client", "server", "device", "system", "user", "application", "gateway", "inverter"],
    "security": ["client", "server", "device", "system", "user", "application", "administrator", "subject", "object"],
}

# Words and patterns that tell a domain.
GRID_WORDS = ["2030.5", "smart grid", "der", "inverter", "telemetry", "voltage", "ieee std"]
GRID_PATTERNS = [r"\bieee\s+\d+\b", r"\bsep\s*2\b", r"\bvoltage\b"]
SECURITY_WORDS = ["iso 27001", "oauth", "tls", "cryptographic", "cybersecurity", "confidentiality", "rbac", "authentication"]
SECURITY_PATTERNS = [r"\baccess\s+control\b", r"\bsecure\s+transport\b"]

ROLES = {
    "generic": "Judge clarity, determinism, testability and completeness.",
    "smartGrid": "Judge grid communication, transport security, latency and protocol use.",
    "security": "Judge threats, cryptography, identity, access control and data protection.",
}
TEMPLATE = """{role_description}

TARGETS
{target_requirements}

STRUCTURE
{structural_context}

LINKED RULES
{linked_rules}

TERMS
{referenced_terms}

POSSIBLE CONFLICTS
{potential_conflicts}

{additional_domain_info_section}"""


def java(pattern: str) -> str:
    """A pattern with ASCII word boundaries and Unicode spaces, without regard to case."""
    if re.fullmatch(r"\\b\w(?:\w|\\[sd]|[ |()?:]|(?<=\\[sd])[+*])*\\b", pattern):  # a word character at either end
        pattern = BEGIN + pattern[2:-2] + END
    return "(?i)" + pattern.replace(r"\b", B).replace(r"\s", WS).replace(r"\d", "[0-9]")


def forms_of(pattern: str) -> list[tuple[str, str]] | None:
    """What a pattern of letters, optional letters and groups of alternatives can match, as (where, text); None for any other pattern.

    where is "whole" between two word boundaries, "starts" after one and "ends" before one.
    """
    out = []
    for part in _alternatives(pattern):
        left, right = part.startswith(r"\b"), part.endswith(r"\b")
        texts = _spelled(part[2 if left else 0 : -2 if right else None].lower())
        if texts is None or not (left or right):
            return None
        where = "whole" if left and right else "starts" if left else "ends"
        if where != "whole" and not all(re.fullmatch(r"[a-z0-9_]{3,}", t) for t in texts):
            return None
        out += [(where, t) for t in texts if t]
    return list(dict.fromkeys(out))


def _alternatives(pattern: str) -> list[str]:
    """The parts between bars that stand in no group."""
    parts, depth = [""], 0
    for c in re.findall(r"\\.|.", pattern, re.S):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _spelled(part: str) -> list[str] | None:
    """Every text that a pattern without bars outside groups can match, or None."""
    out, at = [""], 0
    one = re.compile(r"(?:\\(?P<escaped>[^a-z0-9])|(?P<plain>[^\\.*+?^${}()|\[\]])|\(\?:(?P<group>[^()]*)\))(?P<maybe>\??)", re.S)
    while at < len(part):
        m = one.match(part, at)
        if not m or part[m.end() : m.end() + 1] in ("*", "+", "{", "?"):
            return None
        if m["group"] is None:
            options = [m["escaped"] or m["plain"]]
        else:
            inner = [_spelled(x) for x in m["group"].split("|")]
            if any(x is None for x in inner):
                return None
            options = [t for x in inner for t in x]
        out = [a + b for a in out for b in (["", *options] if m["maybe"] else options)]
        at = m.end()
    return out


@dataclass(frozen=True)
class Domain:
    """What the operators need to know of a field of work. All lists are small."""

    name: str
    terms: dict[str, str] = field(default_factory=dict)  # in order; patterns with \\b
    stopwords: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    actors: tuple[str, ...] = ()
    role: str = ""
    template: str = TEMPLATE
    info: str = ""


def domain(name: str = "generic", terms: dict[str, str] | None = None, stopwords=(), headers=(), actors=(), info: str = "") -> Domain:
    """A preset (generic if there is none of the name) with more terms, stop words, headers and actors, each once."""
    name = name if name in TERMS else "generic"
    own = {t: OWN_PATTERNS.get((name, t), rf"\b{t}s?\b") for t in TERMS[name]} | {t: rf"\b{p}s?\b" for t, p in (terms or {}).items()}
    once = lambda *xs: tuple(dict.fromkeys(x for part in xs for x in part))
    return replace(Domain(name), terms=own, stopwords=once(STOPWORDS, MORE_STOPWORDS[name], stopwords), headers=once(HEADERS[name], headers), actors=once(ACTORS[name], actors), role=ROLES[name], info=info)


def domain_scores(text: Column) -> tuple[Column, Column]:
    """Points of the grid and the security domain: 1.5 for a word anywhere in the text, 1 for a pattern, which begins with a plain word."""
    low = F.lower(text)

    def points(words: list[str], patterns: list[str]) -> Column:
        parts = [F.when(F.contains(low, F.lit(w)), 1.5).otherwise(0.0) for w in words] + [F.when(F.contains(low, F.lit(re.match(r"\\b(\w+)", p)[1])) & low.rlike(java(p)), 1.0).otherwise(0.0) for p in patterns]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    return points(GRID_WORDS, GRID_PATTERNS), points(SECURITY_WORDS, SECURITY_PATTERNS)


def detect_domain(text: Column) -> Column:
    grid, security = domain_scores(text)
    return F.when((grid > 1) & (grid >= security), "smartGrid").when((security > 1) & (security > grid), "security").otherwise("generic")
