"""Text expressions: white space, words, names, hashes, fences. All take and give Columns.

Lengths are in code points. White space is what scripts of the web call white space: ASCII
white space, no-break space, byte order mark and the Unicode spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and language codes with the text-search configuration each stands for.
SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LANGUAGES = {
    "en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "sv": "swedish",
    "no": "norwegian", "da": "danish", "fi": "finnish", "hu": "hungarian", "ro": "romanian", "ru": "russian", "tr": "turkish",
}
# End of the fixed values.


#: The characters of SPACE.
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trimmed_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace(r"[\s", r"[^\s") + "+")), F.lit(0)).cast("long")


def token_estimate(text: Column) -> Column:
    """Four tokens for three words, rounded up."""
    return F.ceil(word_count(text) / 0.75).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def kebab(text: Column) -> Column:
    """Lower case, runs of anything else as one hyphen, at most 80 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"\A-+|-+\z", ""), 1, 80)


def slug(text: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(kebab(text), 1, most), r"-+\z", "")


def domain_slug(name: Column) -> Column:
    """A name as a slug of any length; "domain" where nothing is left of it."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.btrim(name), "[^a-zA-Z0-9]+", "-")), r"\A-+|-+\z", "")
    return F.coalesce(F.when(bare != "", bare), F.lit("domain"))


def title_case(text: Column) -> Column:
    one = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))
    return F.array_join(F.transform(words(text), one), " ")


def source_name(name: Column, source_hash: Column) -> Column:
    """The file's name, or one made from the hash where there is none."""
    given = trimmed(name)
    return F.coalesce(F.when(given != "", given), F.concat(F.lit("upload-"), F.substring(source_hash, 1, 8), F.lit(".txt")))


def inferred_title(name: Column, text: Column) -> Column:
    """From the file's name, else the first line with text, else a constant."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(trimmed(name), r"(?i)\.[a-z0-9]+\z", ""), "[_-]+", " "))
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    return F.coalesce(F.when(bare != "", title_case(bare)), F.substring(F.get(lines, F.lit(0)), 1, 120), F.lit("Compliance Document"))


def language(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(code)), code)


def fenced(text: Column, greedy: bool = True) -> Column:
    """What stands in a Markdown fence: up to the last one, or to the first; the text itself, trimmed, without one."""
    body = F.regexp_extract(text, r"(?s)```(?:markdown|md)?[ \t]*\n(.%s)\n?```" % ("*" if greedy else "*?"), 1)
    return trimmed(F.when(body != "", body).otherwise(text))


def front_block(text: Column) -> Column:
    """The metadata block with its delimiters, also from inside a yaml fence; null without one."""
    raw = F.regexp_extract(text, r"(?s)\A\s*(---\r?\n.*?\r?\n---)", 1)
    fence = F.regexp_extract(text, r"(?s)```(?:ya?ml)?[ \t]*\r?\n(---\r?\n.*?\r?\n---)\s*```", 1)
    return F.coalesce(F.when(raw != "", raw), F.when(fence != "", fence))


def storage_path(org: Column, session: Column, doc: Column, name: Column) -> Column:
    safe = F.substring(F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_"), 1, 200)
    return F.concat_ws("/", F.coalesce(org, F.lit("no-org")), session, doc, safe)
