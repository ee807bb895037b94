"""Text-search configurations: what a policy's texts and queries are reduced to before they meet.

`simple` takes words as they are.  `english` drops stop words, which keep their place, so that phrases over them still
need the words on both sides as far apart, and reduces the others to stems by the rules of the second Porter stemmer.
"""

from __future__ import annotations

import functools
import re

from siltstone.types import EngineError

#: English stop words; fixed values.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can
    will just don should now""".split()
)
_VOWEL, _DOUBLE, _VALID_LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
#: Words that the rules would get wrong; fixed values.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _regions(word: str) -> tuple[int, int]:
    """Where the parts begin that follow the first, and then the second, consonant after a vowel."""

    def after(start: int) -> int:
        m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
        return m.end() if m else len(word)

    begin = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    first = after(0) if begin is None else begin
    return first, after(first)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return re.search(rf"(?:^[{_VOWEL}][^{_VOWEL}]|[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY])$", word) is not None


@functools.lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if word in _SPECIAL:
        return _SPECIAL[word]
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # A y that is a consonant is told from one that is a vowel.
    word = re.sub(rf"^y|(?<=[{_VOWEL}])y", "Y", word)
    first, second = _regions(word)
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", word[:-2]):
        word = word[:-1]
    if word.lower() in _KEPT:
        return word.lower()
    # Past and progressive forms.
    if (end := next((e for e in ("eedly", "eed") if word.endswith(e)), None)) is not None:
        if len(word) - len(end) >= first:
            word = word[: len(word) - len(end)] + "ee"
    elif (end := next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)) is not None and re.search(f"[{_VOWEL}]", word[: len(word) - len(end)]):
        word = word[: len(word) - len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif first >= len(word) and _short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    # Compound suffixes, then single ones, in the parts where they are.
    for rules in (_STEP2, _STEP3):
        for end, instead in [*rules, *([("ogi", "og"), ("li", "")] if rules is _STEP2 else [("ative", "")])]:
            if not word.endswith(end):
                continue
            stem_ = word[: len(word) - len(end)]
            needed = second if end == "ative" else first
            if len(stem_) >= needed and (end != "ogi" or stem_.endswith("l")) and (end != "li" or stem_[-1:] in _VALID_LI):
                word = stem_ + instead
            break
    if (end := next((e for e in _STEP4 if word.endswith(e)), None)) is not None:
        if len(word) - len(end) >= second:
            word = word[: len(word) - len(end)]
    elif word.endswith(("sion", "tion")) and len(word) - 3 >= second:
        word = word[:-3]
    if word.endswith("e") and (len(word) - 1 >= second or len(word) - 1 >= first and not _short(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


CONFIGURATIONS = ("simple", "english")


def reduced(term: str, configuration: str) -> str | None:
    """What a word is under a configuration; None where it is a stop word."""
    if configuration not in CONFIGURATIONS:
        raise EngineError("INVALID_ARGUMENT", f"no configuration {configuration}")
    return term if configuration == "simple" else None if term in STOP else stem(term)


def phrase(terms: list[str], configuration: str) -> list[tuple[int, str]]:
    """A phrase's words as they are matched, each with how far it is from the first that is."""
    kept = [(i, x) for i, t in enumerate(terms) if (x := reduced(t, configuration)) is not None]
    return [(i - kept[0][0], x) for i, x in kept]
