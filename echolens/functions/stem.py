"""Stemming for keyword match: the published Snowball algorithms for Russian and English (Porter2), written from their descriptions."""

from __future__ import annotations

import re

# Endings of the Russian algorithm, grouped as its description groups them.
GERUND_1 = ("вшись", "вши", "в")
GERUND_2 = ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
SUPERLATIVE = ("ейш", "ейше")
DERIVATION = ("ост", "ость")
VOWELS_RU = "аеиоуыэюя"
# Words that full-text search leaves out.
STOP_RU = set("и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split())
STOP_EN = set("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())


def _cut(word: str, start: int, endings: tuple[str, ...], after: str = "") -> str | None:
    """The word without its longest ending of the list inside the region, if one fits (``after``: it must follow one of these letters)."""
    for e in sorted(endings, key=len, reverse=True):
        if len(word) - len(e) >= start and word.endswith(e):
            before = word[: len(word) - len(e)]
            if not after or (len(before) > start and before[-1] in after):
                return before
            if after:
                continue
    return None


def russian(word: str) -> str:
    w = word.lower().replace("ё", "е")
    m = re.search(f"[{VOWELS_RU}]", w)
    if not m:
        return w
    rv = m.end()
    r1 = re.search(f"[{VOWELS_RU}][^{VOWELS_RU}]", w)
    r1 = r1.end() if r1 else len(w)
    r2 = re.search(f"[{VOWELS_RU}][^{VOWELS_RU}]", w[r1:])
    r2 = r1 + r2.end() if r2 else len(w)

    def first(*choices: tuple[tuple[str, ...], str]) -> str | None:
        found = [x for endings, after in choices if (x := _cut(w, rv, endings, after)) is not None]
        return min(found, key=len) if found else None

    if (x := first((GERUND_1, "ая"), (GERUND_2, ""))) is not None:
        w = x
    else:
        w = _cut(w, rv, REFLEXIVE) or w
        if (x := _cut(w, rv, ADJECTIVE)) is not None:
            w = x
            w = first((PARTICIPLE_1, "ая"), (PARTICIPLE_2, "")) or w
        elif (x := first((VERB_1, "ая"), (VERB_2, ""))) is not None:
            w = x
        else:
            w = _cut(w, rv, NOUN) or w
    if len(w) > rv and w.endswith("и"):
        w = w[:-1]
    w = _cut(w, r2, DERIVATION) or w
    if w.endswith("нн") and len(w) - 1 >= rv:
        return w[:-1]
    if (x := _cut(w, rv, SUPERLATIVE)) is not None:
        return x[:-1] if x.endswith("нн") else x
    return w[:-1] if len(w) > rv and w.endswith("ь") else w


SPECIAL_EN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
V, DOUBLE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def english(word: str) -> str:
    w = word.lower().replace("'s", "").strip("'")
    if len(w) < 3:
        return w
    if w in SPECIAL_EN:
        return SPECIAL_EN[w]
    w = re.sub(f"(^|[{V}])y", r"\1Y", w)

    def region(start: int) -> int:
        m = re.search(f"[{V}][^{V}]", w[start:])
        return start + m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    r2 = region(r1)

    def short() -> bool:
        return r1 >= len(w) and bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w) or re.fullmatch(f"[{V}][^{V}]", w))

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    for e in ("eedly", "eed"):
        if w.endswith(e):
            w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
            break
    else:
        for e in ("ingly", "edly", "ing", "ed"):
            if w.endswith(e):
                if re.search(f"[{V}]", w[: -len(e)]):
                    w = w[: -len(e)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLE):
                        w = w[:-1]
                    elif short():
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for e in sorted([*STEP_2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r1:
                if e == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif e == "li":
                    w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
                else:
                    w = w[: -len(e)] + STEP_2[e]
            break
    for e in sorted([*STEP_3, "ative"], key=len, reverse=True):
        if w.endswith(e):
            if e == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(e) >= r1:
                w = w[: -len(e)] + STEP_3[e]
            break
    for e in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e"):
        stem = w[:-1]
        bare = bool(re.search(f"[^{V}][{V}][^{V}wxY]$", stem) or re.fullmatch(f"[{V}][^{V}]", stem))
        w = stem if len(stem) >= r2 or (len(stem) >= r1 and not bare) else w
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


WORD = re.compile(r"[^\W_]+", re.UNICODE)


def lexemes(text: str, config: str) -> set[str]:
    """Stems of a text for the ``russian`` or ``english`` configuration; the Russian one stems ASCII words as English."""
    out = set()
    for w in WORD.findall((text or "").lower()):
        if config == "russian" and not w.isascii():
            if w not in STOP_RU:
                out.add(russian(w))
        elif w not in STOP_EN:
            out.add(english(w))
    return out
