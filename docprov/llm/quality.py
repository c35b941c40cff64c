"""Line-first quality rules.

Each line of a text is judged on its own by punctuation, navigation and boilerplate rules
(phrases and words of English, German, French and Spanish); failing lines are removed; a document that loses too much of its text is rejected. Word
and line counts of the whole text are given beside the verdict.

Defined results: null and empty texts have counts of 0, keep no text and are rejected
(fewer than `min_words` words); repeated rows are judged alike; texts of any length are
judged whole, in time linear in their length; an empty table gives an empty result; other
columns are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docprov.llm.common import WORD, map_columns

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
# What navigation and boilerplate lines consist of.
SEPARATORS = {"|", "»", "›", "·", "•", "/", ">", "::", "→"}
NAVIGATION = set(
    "home menu login log sign register search sitemap next previous prev back top share tweet print contact about faq help rss skip content main "
    "start startseite menü kontakt suche suchen anmelden abmelden registrieren weiter zurück übersicht impressum datenschutz hilfe teilen drucken inhalt "
    "accueil recherche rechercher connexion déconnexion inscription suivant précédent retour aide partager imprimer contenu "
    "inicio contacto buscar acceder registrarse entrar salir siguiente anterior volver ayuda compartir imprimir nosotros contenido".split()
)
#: Words that stand between those, and are none by themselves.
JOINING = set("plan site propos mapa sitio acerca in out up us to über uns zum zur à du de des la le les del el".split())
BOILERPLATE = re.compile(
    r"(?i:all rights reserved|cookie (?:policy|settings|notice)|use of cookies|we use cookies|privacy policy|terms (?:of (?:use|service)|and conditions)|subscribe to our|newsletter|enable javascript|lorem ipsum|click here|read more\b|powered by|©|copyright \(c\)|licensed under|permission is hereby granted|SPDX-License-Identifier|provided \"as is\""
    r"|alle rechte vorbehalten|wir verwenden cookies|verwendung von cookies|cookie-(?:richtlinie|einstellungen|hinweis)|datenschutzerklärung|datenschutzhinweise|nutzungsbedingungen|allgemeine geschäftsbedingungen|hier klicken|klicken sie hier|mehr erfahren\b|mehr lesen\b|weiterlesen\b|jetzt abonnieren"
    r"|tous droits réservés|nous utilisons des cookies|utilisation de cookies|politique de (?:confidentialité|cookies)|mentions légales|conditions (?:générales|d.utilisation)|cliquez ici|lire la suite|en savoir plus|abonnez-vous"
    r"|todos los derechos reservados|(?:utilizamos|usamos) cookies|uso de cookies|política de (?:privacidad|cookies)|aviso legal|términos (?:y condiciones|de uso)|haga clic aquí|haz clic aquí|leer más\b|suscríb(?:ete|ase)\b)"
)
#: Letters of which each of these phrases holds some, in lower case.
TELLING = ("rights reserved", "cookie", "privacy", "terms ", "subscribe", "newsletter", "javascript", "lorem", "click here", "read more", "powered by", "©", "copyright", "licensed", "permission", "spdx", "provided", "rechte vorbehalten", "datenschutz", "bedingungen", "klicken", "mehr erfahren", "mehr lesen", "weiterlesen", "abonn", "droits", "politique", "mentions", "conditions", "cliquez", "lire la", "savoir plus", "derechos", "política", "aviso", "términos", "clic aqu", "leer más", "suscríb")
#: Letters whose case-insensitive likes are of other alphabets or signs.
ODD_CASE = "ıſKİ"
SENTENCE = re.compile(r"[.!?]+[\"'”’»)]*\s+")
CLOSERS = "\"'”’»)]"
# End of the fixed values.


@dataclass(frozen=True)
class Limits:
    """The rules' parameters, as shares unless they say otherwise."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_words: float = 0.3
    upper_letters: float = 0.7
    separators: float = 0.2
    lost_text: float = 0.3
    short_line: int = 20
    long_sentence: int = 80
    bare_marks: int = 5
    boilerplate: float = 0.5


def boilerplate(n: int, line: str, limits: Limits) -> bool:
    """Whether a line of n words is boilerplate: a short one that holds a phrase of it, or a
    longer one of which more than a share lies in sentences that do. Of a sentence too long to
    be one, only the words beside each phrase count, as many as a short line has at most."""
    phrase = BOILERPLATE.search(line)
    if not phrase or n < limits.short_line:
        return phrase is not None
    marked, at = 0, 0
    for end in [*(m.end() for m in SENTENCE.finditer(line)), len(line)]:
        sentence = line[at:end]
        at = end
        phrases = list(BOILERPLATE.finditer(sentence))
        if not phrases:
            continue
        words = [m.span() for m in WORDS.finditer(sentence)]
        if len(words) <= limits.long_sentence:
            marked += len(words)
            continue
        starts, upto = [a for a, _ in words], 0
        for p in phrases:
            first, last = bisect_right(starts, p.start()) - 1, bisect_left(starts, p.end())
            beside = max(0, limits.short_line - (last - first)) // 2
            first, last = max(first - beside, upto), min(last + beside, len(words))
            marked += max(0, last - first)
            upto = max(upto, last)
    return marked > limits.boilerplate * n


def may_hold_phrases(text: str) -> bool:
    """Whether a text can hold a phrase of boilerplate: a cheap test that spares most texts the patterns."""
    low = text.lower()
    return any(t in low for t in TELLING) or any(c in text for c in ODD_CASE)


def line_fails(words: list[str], line: str, limits: Limits, phrases: bool = True) -> str:
    """The first rule that a line with words breaks, or an empty string; boilerplate is looked for if there may be some."""
    n = len(words)
    if phrases and boilerplate(n, line, limits):
        return "boilerplate"
    bars = sum(w in SEPARATORS for w in words)
    if bars >= 2 and bars > limits.separators * n:
        return "navigation"
    if n <= 8:
        bare = [w.strip(".,:;!?").lower() for w in words if w not in SEPARATORS]
        if any(w in NAVIGATION for w in bare) and all(w in NAVIGATION or w in JOINING for w in bare):
            return "navigation"
    if not words[0][0].isalnum() and sum(map(len, words)) >= limits.bare_marks and not any(c.isalnum() for c in line):
        return "punctuation"
    if SYMBOLS.search(line):
        marked = sum(1 for w in words if w[-1] in "#*$%&|<>")
        if marked >= 2 and marked > limits.symbol_words * n:
            return "punctuation"
    shouted = sum(w.rstrip(CLOSERS).endswith("!!") for w in words)
    if shouted >= 2 and shouted > limits.symbol_words * n:
        return "punctuation"
    if n >= 3 and line.upper() == line:
        letters = [c for c in line if c.isalpha()]
        if len(letters) >= 10 and sum(c.isupper() for c in letters) > limits.upper_letters * len(letters):
            return "punctuation"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    count, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 3 - max(i, upto)
            upto = i + 3
    return count


def judge(text: str, limits: Limits = Limits()) -> dict:
    """Counts and verdict of one text, with the text that remains."""
    words = WORDS.findall(text)
    chars, seen, duplicates, lost, rules = sum(map(len, words)), set(), 0, 0, Counter()
    kept: list[str] = []
    phrases = may_hold_phrases(text)
    for line in text.split("\n"):
        own = WORDS.findall(line)
        if not own:
            kept.append(line)
            continue
        again = line in seen
        duplicates += again
        seen.add(line)
        rule = line_fails(own, line, limits, phrases) or ("repeated" if again else "")
        if rule:
            rules[rule] += 1
            lost += sum(map(len, own))
        else:
            kept.append(line)
    repeats = repeated_words(words)
    failed = len(words) < limits.min_words or 100 * repeats > limits.repeat_percent * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(SYMBOLS.findall(text)), "n_dup_lines": duplicates, "n_repeat_words": repeats,
        "base_failed": failed, "lost_chars": lost, "lost_lines": sum(rules.values()), "clean_text": "\n".join(kept), "kept": not failed and lost <= limits.lost_text * chars,
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, lost_lines long, kept boolean"


def quality(docs: DataFrame, limits: Limits = Limits(), with_text: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its key, the counts, `kept`, and (unless `with_text` is
    false) `clean_text`, the text without the lines that failed."""

    def run(keys: list, texts: list) -> Iterator[dict[str, list]]:
        found = [judge(t or "", limits) for t in texts]
        yield {key: keys} | {c: [f[c] for f in found] for c in (found[0] if found else {})}

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs, [key, text], run, f"`{key}` {kind}, {SCHEMA}" + ", clean_text string" * with_text)
