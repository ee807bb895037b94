"""Which requests a context bundle takes: it serves only forms that it knows, so it fails closed.

A bundle holds excerpts and can answer no exact question: how many there are, what state something is in, whether
that is all.  A request is therefore cut into its parts (sentences, lines, conjuncts), and each part must be one of
a few forms: a topic, an instruction to explain something, a wish for notes about something, why or how something
came about, what someone said about something, or who wrote it.  What has no such form, or asks for a count, a state
or completeness inside one, is refused; so is a request that names nothing.

There is one implementation, of texts; the column form maps it over batches.  It is a second line of defence only:
what a bundle never returns does not depend on it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


# -- Words, by what they do in a sentence.
_DETERMINER = _any("the a an this that these those our my your his her its their some any")
_PRONOUN = _any("i we you he she it they there me us them")
_AUXILIARY = _any("am is are was were be been has have had do does did will would shall should can could may might must ain't cannot") + r"|\w+n't|\w+'(?:ve|ll|re|m|d)|(?:what|who|that|where|it|he|she|there|how)'s"
_QUESTION = _any("who whom whose which what when where why how whether")
_ABOUT = _any("about on of for from regarding concerning in at with during")
_PASSAGE = _any("notes? records? information info details? excerpts? passages? context background summary summaries overview material documents? entries entry discussions? reports? logs?")
_EXPLAIN = _any("summari[sz]e describe explain outline discuss compare recap clarify paraphrase draft illustrate interpret contrast")
_FETCH = "(?:find|search for|look for|look up|fetch|show|give|get|bring|pull up|retrieve|read)"
#: Bare forms that order something done.
_ORDER = _any("list enumerate itemi[sz]e show give get find fetch provide present furnish compile gather collect produce print dump export return display send bring supply hand reveal tell check confirm verify ensure count quantify tabulate name identify rattle walk fill pull pay fix approve close ship deliver calculate compute determine")
_SAID = _any("say said says write wrote writes written report reported note noted record recorded mention mentioned describe described observe observed conclude concluded recommend recommended claim claimed remark remarked explain explained")
_ADVERB = r"(?:\w{2,}ly|first|second|third|next|finally|afterwards?|also|then|now|again|just|too|in addition|so|and|ok|okay)"
_FUNCTION = set(
    "a an the this that these those it its of on in at to for from by with about and or not as so me us you we i my our your them they he she please hey ok okay"
    " what which who why how when where something anything everything nothing tell can could would know is are be do does did".split()
)

# -- What an exact question is made of, told from how its words stand to one another.
#: States that are no participles; a participle is a state, too.
_STATES = frozenset("open late due overdue ready vacant pending outstanding missing incomplete inactive active current complete broken blocked available online offline live left remaining shut".split())
#: Participles that do not end in -ed.
_BENT = frozenset("paid sent sold done met built read won lost left held known begun written shut broken withdrawn lit drawn".split())
#: Words in -ed that are no participles, and beginnings in un- that deny nothing.
_NOT_BENT = frozenset("need seed feed speed weed bed red shed bleed breed deed reed indeed exceed proceed succeed happened".split())
_UN = re.compile(r"un(?!der|til|ion|it|ique|iverse)\w+")
_BE = frozenset("am is are was were be been being isn't aren't wasn't weren't".split())
_HAVE = frozenset("has have had hasn't haven't hadn't got get gets getting".split())
_MEASURES = frozenset("many much often frequently numerous".split())
_WHOLE = frozenset("all every each everyone everybody".split())
_SETS = frozenset("set list roster inventory register directory catalog index collection names".split())


def _stem(word: str) -> str:
    """A noun's singular or a verb's base, as far as these rules need it."""
    for end, instead in (("ies", "y"), ("ied", "y"), ("lled", "l"), ("lling", "l")):
        if word.endswith(end) and len(word) > len(end) + 2:
            return word[: -len(end)] + instead
    for end in ("ing", "ed", "s"):
        if word.endswith(end) and not word.endswith("ss") and len(word) > len(end) + 2:
            return word[: -len(end)]
    return word


def _bent(word: str) -> bool:
    return re.sub("^(?:re|un|over)", "", word) in _BENT or word.endswith("ed") and len(word) > 3 and word not in _NOT_BENT


def _state(word: str) -> bool:
    return word in _STATES or _bent(word)


def _undone(word: str) -> bool:
    """A state that something has not reached, or is past."""
    return bool(_UN.fullmatch(word)) and _bent(word) or word in ("overdue", "outstanding", "missing", "pending", "open", "unresolved", "remaining")


def _plural(word: str) -> bool:
    return len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "'s", "us", "is"))


def _counts(w: list[str]) -> bool:
    """A measure is asked for: how much of a thing, or a noun of quantity, or what is owed."""
    for a, b in zip(w, [*w[1:], ""], strict=True):
        base = _stem(a)
        if a == "how" and b in _MEASURES or base in ("count", "recount", "headcount", "total", "subtotal", "tally", "quantity", "owe") or a == "owed":
            return True
        if base in ("number", "amount", "size", "sum") and (b in ("of", "owed", "due", "left", "") or base == "sum" and b != "up"):
            return b != "" or base == "sum" or "what" in w
        if a == "how" and b in ("big", "large") and "is" in w:
            return True
    return False


def _completes(w: list[str]) -> bool:
    """All of a kind is asked for: by a word for all of them, by what is left of them, by their being there, or as a list."""
    for i, a in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if a in _WHOLE and after != "about" or a == "everything" and after not in ("about", ""):
            return True
        if a in ("else", "exist", "exists") or a in ("rest", "remainder", "others") and after == "of" or _stem(a) in ("remain", "enumerate", "itemize", "itemise", "enumerat", "itemiz"):
            return True
        if a == "any" and after in ("more", "other", "further") or a == "nothing" and (after == "else" or _state(after)):
            return True
        # A thing's being there: "is there", "are any"; "there is more".
        if a in ("is", "are", "was", "were", "be") and (after == "there" or after == "any" and not _bent(w[i + 2] if i + 2 < len(w) else "")):
            return True
        if a == "there" and after in ("is", "are") and "more" in w[i:]:
            return True
        if _stem(a) == "list" and not before.endswith("ing"):
            return True
        if a in ("complete", "full", "entire", "whole", "exhaustive", "comprehensive") and any(x in _SETS or _plural(x) for x in w[i + 1 : i + 4]):
            return True
        if a == "name" and after in ("the", "each", "every", "any"):
            return True
        # What is left of several: "bills outstanding", "items left", "left tickets".
        if a in ("left", "outstanding") and (_plural(before) and after == "" or i == 0 and _plural(after)):
            return True
    return False


def _asks_state(w: list[str]) -> bool:
    """Whether something holds: an auxiliary first, whether or if, a word for a state, or a state said of a thing that a question word or a time picks out."""
    if not w:
        return False
    if re.fullmatch(_AUXILIARY, w[0]) or w[:2] in (["when", "will"], ["how", "is"], ["how", "are"]):
        return True
    picked = False
    for i, a in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if a in ("status", "progress", "whether", "yet", "awaiting") or a in ("confirm", "verify") or a == "check" and after == "that" or a == "make" and after == "sure":
            return True
        if _stem(a) in ("state", "stage", "phase", "condition") and (before in ("what", "which", "current", "overall") or a == "state" and after == "of"):
            return True
        if _stem(a) == "update" and (before == "any" or after == "on") or a == "not" and before == "or" or a == "stand" and after == "on" or w[i : i + 3] == ["how", "far", "along"]:
            return True
        if a in ("duty", "review", "way", "stock") and before in ("on", "off", "under", "in", "out", "of") and (a, before) not in (("way", "on"), ("review", "in"), ("way", "in")):
            return True
        # A state dated or denied: "still open", "not yet paid", "already sent".
        rest = w[i + 1 : i + 3]
        dated = rest and (_state(rest[0]) or rest[0] == "to" or rest[0].endswith("ly") and _state(rest[-1]))
        if a in ("still", "not", "never", "already", "longer") and dated or a == "still" and any(map(_state, w[i:])):
            return True
        if a in ("marked", "got", "gets", "been", "being", "be", "now") and any(_state(x) for x in rest):
            return True
        if a == "if" and after != "any" and any(re.fullmatch(_AUXILIARY, x) or _state(x) or _plural(x) for x in w[i + 1 :]):
            return True
        # Which of them: a question word, and then a state that they are, have been or got into.
        if a in ("which", "what", "who", "whose"):
            picked = True
            near = w[i + 1 : i + 5]
            if a in ("which", "what", "whose") and any(_state(x) and x != "happened" and (near + [""])[k + 1] != "about" for k, x in enumerate(near) if k > 0):
                return True
            if a == "what" and after == "is" and w[i + 2 : i + 3] in (["left"], ["missing"]):
                return True
        elif picked and (a in _BE or a in _HAVE or a == "never") and any(map(_state, w[i + 1 :])):
            return True
    return False


def _selects(w: list[str]) -> bool:
    """Things named by a state that they have not reached: a selection even where the form is served."""
    for i, a in enumerate(w[:-1]):
        after = w[i + 1]
        if _undone(a) and _plural(after) and not any(x.endswith("ing") for x in w[i + 2 : i + 3]) or a in ("not", "never") and _state(after):
            return True
    return False


def _stated(w: list[str]) -> bool:
    return any(map(_state, w))


# -- Cutting a request into parts.
_BOUNDARY = re.compile(r"[\n\r\t\v\f\x1c-\x1e\x85\u2028\u2029\u3000.!?;:,/|&+\u2022\u00b7*()\"~=><#\u2190-\u21ff]+|--+|\s[-\u2013\u2014]+\s|[\u2013\u2014]+|^\s*[-\u2013\u2014]+\s*", re.M)
_COORDINATOR = re.compile(r"\b(?:and then|and also|and|or|but|then|plus|as well as|after that|followed by|also)\b")
_POLITE = re.compile(
    rf"^(?:(?:please|hey|hi|hello|kindly|{_ADVERB}|(?:can|could|would|will) you(?: please)?|i'd like you to|i (?:want|need|would like) you to|let's)\s+)+"
)

_TOPIC = r"(?P<topic>.+)"
_WANTED = r"(?:i (?:need|want|would like)|i'd like|can i (?:see|have|get)|do you have)"
_FORMS = [
    # An instruction to explain, of a topic or of how, why or what something is.
    ("explain", re.compile(rf"^{_EXPLAIN} (?:for me |to me )?(?P<clause>(?:how|why|what) .+)")),
    ("explain", re.compile(rf"^{_EXPLAIN} (?:for me |to me )?{_TOPIC}")),
    # Notes and the like about a topic, asked for or named.
    ("notes", re.compile(rf"^(?:(?:{_FETCH})(?: me| us)?|{_WANTED}) (?:{_DETERMINER} )?(?:\w+ ){{0,2}}{_PASSAGE} {_ABOUT} {_TOPIC}")),
    ("notes", re.compile(rf"^(?:{_FETCH})(?: me| us)? (?:{_DETERMINER} )?(?:\w+ ){{0,2}}{_PASSAGE}$")),
    ("notes", re.compile(rf"^(?:tell me|i want to know|i'd like to know|teach me|everything|something|anything) about {_TOPIC}")),
    ("notes", re.compile(rf"^(?:tell me )?(?P<clause>what .+)")),
    ("notes", re.compile(rf"^(?:{_DETERMINER} )?{_PASSAGE} {_ABOUT} (?P<clause>what happened .+)")),
    # Why and how something came about.
    ("cause", re.compile(r"^why (?:did|does|do|was|were|is|are)n?'?t? (?P<event>.+)")),
    ("cause", re.compile(r"^how (?:did|does|do) (?P<event>.+)")),
    ("author", re.compile(rf"^who (?:wrote|reviewed|authored|drafted|recorded|reported|described|noted) {_TOPIC}")),
]
_SAYING = re.compile(rf"^what (?:(?:did|does|do) (?:{_DETERMINER} )?[\w' -]+? {_SAID}|(?:was|is|were) {_SAID}|(?:{_DETERMINER} )?[\w' -]+? {_SAID})(?: {_ABOUT} (?P<topic>.+))?$")
_HAPPENED = re.compile(r"^what happened (?:during|in|at|on|before|after|around|while) (?P<topic>.+)$")
_CLAUSE = re.compile(r"^(?:how|why) (?!many|much|often)(?P<event>.+)$")
_PASSIVE = re.compile(rf"\b(?:is|are|was|were|has been|have been|had been) (?:\w+ly )?\w+(?:ed|en|lt|pt|ft|ung|ut|t|ing|d)\b")


def _has(pattern: str, text: str) -> bool:
    return re.search(rf"\b(?:{pattern})(?![\w'])", text) is not None


def _is_topic(text: str) -> bool:
    """A noun phrase: no clause, no question, nobody told to do something."""
    words = text.split()
    if not set(words) - _FUNCTION or _has(f"{_AUXILIARY}|{_PRONOUN}|{_QUESTION}|if", text):
        return False
    if _has(rf"(?:{_ORDER}|{_FETCH}|{_EXPLAIN}) (?:{_DETERMINER}|all|every|each|me|us|\w+s$)", text):
        return False
    if len(words) > 1 and re.fullmatch(_DETERMINER, words[1]) and not re.fullmatch(rf"{_DETERMINER}|{_ABOUT}|by|to|into|as|between|before|after|under|over", words[0]):
        return False
    if len(words) > 1 and words[1] in ("off", "up", "out", "through"):
        return False
    if re.fullmatch(rf"{_ABOUT}|by|to|into", words[-1]) or re.fullmatch(_EXPLAIN, words[0]) and not re.fullmatch(_ABOUT, words[min(1, len(words) - 1)]):
        return False
    return not (re.fullmatch(_ORDER, words[0]) and len(words) > 1 and not re.fullmatch(_ABOUT, words[1]))


def _is_event(text: str) -> bool:
    """What a why or how asks of: a subject and what it did, no further clause."""
    rest = _PASSIVE.sub(" ", text, count=1)
    return bool(set(text.split()) - _FUNCTION) and not _has(f"{_AUXILIARY}|{_QUESTION}|if|to|{_any('i we you they there')}", rest) and not _has(rf"(?:{_ORDER}) {_DETERMINER}", rest)


def _is_clause(text: str) -> bool:
    said = _SAYING.match(text) or _HAPPENED.match(text)
    if said:
        topic = said.groupdict().get("topic")
        subject = text if topic is None else text[: said.start("topic")]
        return not _has(_any("i we you they there else"), subject) and (topic is None or _is_topic(topic))
    event = _CLAUSE.match(text)
    return event is not None and _is_event(event["event"])


def _form(part: str, later: bool) -> str | None:
    for name, pattern in _FORMS:
        m = pattern.match(part)
        if m is None:
            continue
        found = m.groupdict()
        if found.get("clause"):
            if _is_clause(found["clause"]):
                return name
        elif found.get("event"):
            if _is_event(found["event"]):
                return name
        elif not found.get("topic") or _is_topic(found["topic"]) or later and found["topic"] in ("it", "them"):
            return name
    return "topic" if _is_topic(part) else None


def normalised(request: str, invisible: str = "") -> str:
    """Lower-case text without marks on letters; characters that do not show read as nothing or as a space."""
    text = "".join(invisible if unicodedata.category(c) == "Cf" or 0xE0000 <= ord(c) <= 0xE007F else c for c in request)
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn" and unicodedata.category(c) != "Cf")
    return text.replace("\u2019", "'").replace("_", " ")


def parts(text: str) -> list[tuple[str, bool]]:
    """The parts of a normal text, each with whether it is asked with a question mark."""
    out = []
    at = 0
    for m in [*_BOUNDARY.finditer(text), None]:
        piece, asked = text[at : m.start() if m else len(text)], bool(m) and "?" in m[0]
        at = m.end() if m else len(text)
        words = " ".join(re.findall(r"[\w']+", piece))
        for sub in _COORDINATOR.split(words):
            sub = _POLITE.sub("", sub.strip() + " ").strip()
            if re.search(r"[a-z\u0080-\uffff]", sub):
                out.append((sub, asked))
    return out


#: Openings that ask for notes and so say nothing of a state.
_ASKED = re.compile(rf"^{_WANTED} ")


def _exact(text: str) -> str | None:
    """The kind of exact question that a text asks, by its grammar, or None."""
    w = text.split()
    return "count" if _counts(w) else "completeness" if _completes(w) else "status" if _asks_state(w) else None


def _inside(part: str, form: str | None) -> str | None:
    """What a part of some form asks that no bundle can answer."""
    w = part.split()
    if form in ("cause", "explain") and not _selects(w) and not set(w) & {"whether", "status", "which", "not"} and not _counts(w) and not _completes(w):
        return None  # why and how something came to be, which names states without asking for them
    found = _exact(_ASKED.sub("", part) if form else part)
    if found is None and form in ("explain", "notes") and _selects(w):
        found = "status"
    if found is None and form == "topic" and _stated(w):
        found = "completeness" if set(w) & {"left", "remaining"} else "status"
    return found


def _read(text: str) -> str:
    found = parts(text)
    if not any(set(p.split()) - _FUNCTION for p, _ in found):
        return "unrecognized"
    whole, refused = " ".join(re.findall(r"[\w']+", text)), None
    for k, (part, asked) in enumerate(found):
        if part in ("so on", "so forth", "the like", "etc"):
            refused = refused or "unrecognized"
            continue
        form = _form(part, k > 0)
        hard = _inside(part, form)
        if form == "topic" and hard is None and asked and len(found) == 1:
            hard = "unrecognized"
        if hard or form is None:
            kind = hard or _exact(whole) or ("status" if _stated(part.split()) and _has(f"{_AUXILIARY}|{_QUESTION}|me|us", part) else "unrecognized")
            refused = refused if refused not in (None, "unrecognized") else kind
    return refused or "served"


def classify(request: str | None) -> str:
    """served, or why it is refused: count, completeness, status, or unrecognized. A null request is unrecognized."""
    if request is None:
        return "unrecognized"
    readings = [_read(normalised(request, invisible)) for invisible in ("", " ")]
    return next((r for r in readings if r not in ("served", "unrecognized")), next((r for r in readings if r != "served"), "served"))


def classified(request: Column) -> Column:
    """The kind of each request; the same function, over batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: classify(None if t is None or t is pd.NA else t), na_action=None)

    return run(request)
