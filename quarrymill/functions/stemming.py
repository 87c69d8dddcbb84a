"""English stemming after M. F. Porter, "An algorithm for suffix stripping" (1980), and the stop words of English full text.

A word is [C](VC){m}[V]: C and V are runs of consonants and vowels, y is a vowel behind a consonant, m the measure. A rule
takes the longest suffix that fits and replaces it if the stem before it meets the rule's condition.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that English full text leaves out; fixed values.
STOP_WORDS = frozenset("""
a about above after again against all am an and any are as at be because been before being below between both but by can
did do does doing don down during each few for from further had has have having he her here hers herself him himself his
how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with you your
yours yourself yourselves
""".split())  # fmt: skip

#: The algorithm's suffixes by step and what replaces them; fixed values.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = frozenset(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))


def marked(word: str) -> str:
    """The word with each consonant y in upper case."""
    if "y" not in word:
        return word
    out: list[str] = []
    for c in word:
        out.append("Y" if c == "y" and (not out or out[-1] in "aeiouy") else c)
    return "".join(out)


_MEASURED = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]+")
_TWICE = re.compile(r"[^aeiouy]*(?:[aeiouy]+[^aeiouy]+){2}")
_ONCE = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$")


#: The last letters of a step's suffixes: most words have none of them.
_LAST_2, _LAST_3 = (frozenset(end[-1] for end in rules) for rules in (STEP_2, STEP_3))


def _replaced(word: str, rules: dict[str, str], condition: re.Pattern) -> str:
    """The word after the rule with the longest suffix it has, if the stem meets the condition."""
    for n in range(min(7, len(word)), 1, -1):
        if (end := word[-n:].lower()) in rules:
            return word[:-n] + rules[end] if condition.match(word[:-n]) else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = marked(word)
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _MEASURED.match(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _VOWEL.search(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                    w = w[:-1]
                elif _ONCE.match(w) and _SHORT.search(w):
                    w += "e"
                break
    if w[-1] in "yY" and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    if w[-1] in _LAST_2:
        w = _replaced(w, STEP_2, _MEASURED)
    if w[-1] in _LAST_3:
        w = _replaced(w, STEP_3, _MEASURED)
    for n in (5, 4, 3, 2):
        if w[-n:].lower() in STEP_4 and len(w) >= n:
            if _TWICE.match(w[:-n]) and (w[-n:] != "ion" or w[:-n].endswith(("s", "t"))):
                w = w[:-n]
            break
    if w.endswith("e") and (_TWICE.match(w[:-1]) or (_MEASURED.match(w[:-1]) and not (_ONCE.match(w[:-1]) and _SHORT.search(w[:-1])))):
        w = w[:-1]
    if w.endswith("ll") and _TWICE.match(w):
        w = w[:-1]
    return w.lower()


def stem_sql(word: str) -> str:
    """The same as a DuckDB expression over ``word``, step by step, for oracles."""
    c, v = "[^aeiouy]", "[aeiouy]"
    m1, m2 = f"^{c}*{v}+{c}+", f"^{c}*({v}+{c}+)({v}+{c}+)"
    once, short = f"^{c}*{v}+{c}+{v}*$", f"{c}{v}[^aeiouywxY]$"
    cut = lambda n: f"left(w, length(w) - {n})"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"

    def rules(table: dict[str, str], condition: str) -> str:
        longest = sorted(table, key=len, reverse=True)
        return "case " + " ".join(f"when suffix(lower(w), '{s}') then case when {has(cut(len(s)), condition)} then {cut(len(s))} || '{table[s]}' else w end" for s in longest) + " else w end"

    twice = "|".join(x * 2 for x in "bcdfghjkmnpqrtvwx")
    steps = [
        "case when suffix(w, 'sses') or suffix(w, 'ies') then left(w, length(w) - 2) when suffix(w, 's') and not suffix(w, 'ss') then left(w, length(w) - 1) else w end",
        f"case when suffix(w, 'eed') then case when {has(cut(3), m1)} then {cut(1)} else w end when suffix(w, 'ed') and {has(cut(2), v)} then {cut(2)} || '#' when suffix(w, 'ing') and {has(cut(3), v)} then {cut(3)} || '#' else w end",
        f"case when not suffix(w, '#') then w when regexp_matches(w, '(at|bl|iz)#$') then {cut(1)} || 'e' when regexp_matches(w, '({twice})#$') then {cut(2)} when {has(cut(1), once)} and {has(cut(1), short)} then {cut(1)} || 'e' else {cut(1)} end",
        f"case when suffix(lower(w), 'y') and {has(cut(1), v)} then {cut(1)} || 'i' else w end",
        rules(STEP_2, m1),
        rules(STEP_3, m1),
        "case " + " ".join(f"when suffix(lower(w), '{s}') then case when {has(cut(len(s)), m2)}" + (f" and {has(cut(3), '[st]$')}" if s == "ion" else "") + f" then {cut(len(s))} else w end" for s in sorted(STEP_4, key=len, reverse=True)) + " else w end",
        f"case when suffix(w, 'e') and ({has(cut(1), m2)} or ({has(cut(1), m1)} and not ({has(cut(1), once)} and {has(cut(1), short)}))) then {cut(1)} else w end",
        f"case when suffix(w, 'll') and {has('w', m2)} then {cut(1)} else w end",
    ]
    mark = f"list_reduce(list_prepend('', string_split({word}, '')), lambda s, c: s || case when c = 'y' and (s = '' or right(s, 1) in ('a', 'e', 'i', 'o', 'u', 'y')) then 'Y' else c end)"
    out = f"list_extract([{mark}], 1)"
    for step in steps:
        out = f"list_extract(list_transform([{out}], lambda w: {step}), 1)"
    return f"case when length({word}) <= 2 then {word} else lower({out}) end"
