"""Stems of Spanish words by the published Snowball rules."""

from __future__ import annotations

import functools
import re

#: Languages whose words are stemmed, by the names and codes that tables use.
SPANISH = ("spanish", "es", "spa")

# Fixed values of the published algorithm.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS_ACCENTED = "iéndo ándo ár ér ír".split()
GERUNDS = "ando iendo ar er ir".split()
PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENTS = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó e é".split()

#: What a suffix of step 1 becomes in R2, and what goes with it if it stands before, one after the other.
STEP_1: dict[str, tuple[str, tuple[str, ...]]] = (
    {x: ("", ()) for x in PLAIN}
    | {x: ("", ("ic",)) for x in AGENTS}
    | {"logía": ("log", ()), "logías": ("log", ()), "ución": ("u", ()), "uciones": ("u", ()), "encia": ("ente", ()), "encias": ("ente", ())}
    | {"mente": ("", ("ante", "able", "ible")), "amente": ("", ())}
    | {x: ("", ("abil", "ic", "iv")) for x in ("idad", "idades")}
    | {x: ("", ("at",)) for x in ("iva", "ivo", "ivas", "ivos")}
)
_FLAT = str.maketrans("áéíóú", "aeiou")
_VERBS_BEFORE = sorted(GERUNDS_ACCENTED + GERUNDS + ["yendo"], key=len, reverse=True)


def _longest(suffixes) -> re.Pattern:
    return re.compile(f"(?:{'|'.join(sorted(suffixes, key=len, reverse=True))})$")


_PRONOUN, _STEP_1, _Y, _VERB, _REST = _longest(PRONOUNS), _longest(STEP_1), _longest(Y_VERBS), _longest(E_VERBS + VERBS), _longest(RESIDUAL)
_RV = re.compile(f"[^{VOWELS}][{VOWELS}].|[{VOWELS}]{{2}}[{VOWELS}]*[^{VOWELS}]|.[^{VOWELS}]+[{VOWELS}]")
_R = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")


def _after(pattern: re.Pattern, word: str, start: int = 0) -> int:
    found = pattern.match(word, start)
    return found.end() if found else len(word)


def _attached(word: str, rv: int) -> str:
    """Step 0: a pronoun behind an infinitive or gerund goes, and the accent with it."""
    pronoun = _PRONOUN.search(word, rv)
    if not pronoun:
        return word
    rest = word[: pronoun.start()]
    verb = next((x for x in _VERBS_BEFORE if rest.endswith(x)), None)
    if verb is None or len(rest) - len(verb) < rv or (verb == "yendo" and not rest.endswith("uyendo")):
        return word
    return rest[: -len(verb)] + verb.translate(_FLAT)


def _suffix(word: str, r1: int, r2: int) -> str | None:
    """Step 1: a standard suffix goes; None if there is none, or not in its region."""
    found = _STEP_1.search(word)
    if not found:
        return None
    suffix, at = found.group(), found.start()
    if at < (r1 if suffix == "amente" else r2):
        return None
    becomes, before = STEP_1[suffix]
    word = word[:at] + becomes
    if suffix == "amente":
        if word.endswith("iv") and at - 2 >= r2:
            word, at = word[:-2], at - 2
            before = ("at",)
        else:
            before = ("os", "ic", "ad")
    for x in before:
        if word.endswith(x) and at - len(x) >= r2:
            return word[: -len(x)]
    return word


def _verb(word: str, rv: int) -> str:
    """Step 2: the ending of a verb within RV goes."""
    found = _Y.search(word, rv)
    if found and word[: found.start()].endswith("u"):
        return word[: found.start()]
    found = _VERB.search(word, rv)
    if not found:
        return word
    word = word[: found.start()]
    return word[:-1] if found.group() in E_VERBS and word.endswith("gu") else word


@functools.lru_cache(1 << 18)
def spanish(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1 = _after(_RV, word), _after(_R, word)
    r2 = _after(_R, word, r1)
    start = _attached(word, rv)
    word = _suffix(start, r1, r2)
    if word is None:
        word = _verb(start, rv)
    found = _REST.search(word, rv)
    if found:
        word = word[: found.start()]
        if found.group() in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_FLAT)
