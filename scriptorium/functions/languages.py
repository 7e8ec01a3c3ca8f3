"""Language resources: small built-in lists, or files of the user's in the usual layout."""

from __future__ import annotations

#: Abbreviations after which a period doesn't end a sentence, without the period.
NONBREAKING = {
    "en": "Mr Mrs Ms Dr Prof Rev Gen Sen Gov Capt Lt Col Sgt St Jr Sr Inc Ltd Corp Co vs etc approx dept est fig ca cf No Art pp Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split(),
    "de": "bzw ca evtl ggf inkl usw vgl Nr Str Dr Prof Hr Fr Abs Art Bd Hrsg Jan Feb Apr Aug Sept Okt Nov Dez".split(),
    "fr": "M MM Mme Mlle Dr Pr av apr env p pp art etc janv févr juil sept oct nov déc".split(),
    "es": "Sr Sra Srta Dr Dra Prof Ud Uds pág págs art núm etc aprox ej".split(),
    "fi": "esim ns mm ym yms jne klo krs tms eKr jKr prof toim huom ent puh vrt ks os s".split(),
    "et": "jne jt vt nt lk nr prof dr hr pr snd sh st ca".split(),
}
_PRONOUNS = {"'ll": ("will", "I you he she it we they that there who what how"), "'d": ("would", "I you he she it we they who how there"), "'ve": ("have", "I you we they could should would might must"), "'re": ("are", "you we they who what")}
_IS = "he she it that there here who what where when how".split()
_NOT = {"is": "is", "are": "are", "was": "was", "were": "were", "do": "do", "does": "does", "did": "did", "has": "has", "have": "have", "had": "had", "could": "could", "should": "should", "would": "would", "must": "must", "need": "need"}
_OTHER = {"can't": "cannot", "won't": "will not", "shan't": "shall not", "ain't": "is not", "I'm": "I am", "let's": "let us", "'tis": "it is", "'twas": "it was", "gonna": "going to", "gotta": "got to", "wanna": "want to", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock"}


def contractions(lang: str = "en", path: str | None = None) -> list[tuple[str, str]]:
    """(contraction, full form) in the order of application; ``path``: a file of tab-separated pairs."""
    if path:
        return [tuple(row.split("\t")[:2]) for row in word_list(path)]
    if lang != "en":
        return []
    out = [*_OTHER.items(), *((f"{w}n't", f"{full} not") for w, full in _NOT.items()), *((f"{w}'s", f"{w} is") for w in _IS)]
    return out + [(who + short, f"{who} {full}") for short, (full, whos) in _PRONOUNS.items() for who in whos.split()]


def nonbreaking(lang: str, path: str | None = None) -> list[str]:
    return word_list(path) if path else NONBREAKING.get(lang, [])


def word_list(path: str) -> list[str]:
    """The rows of a resource file without blank ones and comments."""
    with open(path, encoding="utf-8") as f:
        return [row for row in map(str.strip, f) if row and not row.startswith("#")]
